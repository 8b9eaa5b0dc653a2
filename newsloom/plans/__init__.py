"""Queries by name over the driver's tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from newsloom.plans import chain, intake, news, news_sql

ORACLE_SQL: dict[str, str] = {**news_sql.ORACLE_SQL, **chain.ORACLE_SQL, **intake.ORACLE_SQL}
QUERIES = {name: getattr(news, name) for name in [*news_sql.ORACLE_SQL, "html_document_parse"]} | chain.QUERIES | intake.QUERIES
