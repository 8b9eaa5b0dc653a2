"""Contracts of run artifacts as a table of rules, evaluated on the artifacts' JSON as VARIANT rows.

The rules of its kind come to each artifact as a list, by a broadcast join, and its items are taken as
maps of their fields, so one plan serves any set of contracts and a new contract is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Version, and (artifact, is a list, required fields, groups of which one field must be there).
VERSION = "0.1.0"
ARTIFACTS = [
    ("candidates", True, ["title", "url", "source_id"], [["published_at", "observed_at", "event_time"]]),
    ("documents", True, ["candidate_url", "title", "source_id", "content"], []),
    ("evidence_chunks", True, ["chunk_id", "url", "source_id", "quote"], []),
    ("claims", True, ["story_id", "text", "source_urls"], []),
    ("claim_verifications", True, ["story_id", "check_status", "evidence_chunk_ids"], []),
    ("stories", True, ["id", "title", "source_urls"], []),
    ("context_packs", True, ["candidate", "evidence"], []),
    ("platform_posts", True, ["story_id", "title", "platforms"], []),
    ("run_manifest", False, ["run_id", "status", "artifact_index"], []),
    ("user_notifications", True, ["notification_id", "severity", "title", "message"], []),
    ("content_quality_report", False, ["overall_score", "gate_status"], []),
    ("rejected_candidates", True, ["title", "url", "source_id"], []),
    ("theme_candidate_pool", False, [], []),
    ("assets", True, ["kind", "source_url"], []),
    ("story_clusters", True, [], []),
    ("theme_sections", False, [], []),
    ("content_review", False, [], []),
    ("material_bundle", False, [], []),
    ("layout_manifest", False, [], []),
    ("render_queue", False, [], []),
]
CRITICAL = ["candidates", "documents", "stories", "platform_posts", "claim_verifications"]
RULE = "artifact_key string, is_list boolean, rule_no int, kind string, fields array<string>"


def contracts(spark: SparkSession, artifacts: list[tuple] = ARTIFACTS) -> DataFrame:
    """(artifact_key, is_list, rule_no, kind, fields): a row for each rule; kind is required, any_of, or none for an artifact without rules."""
    rows = []
    for key, is_list, required, groups in artifacts:
        rules = [("required", [f]) for f in required] + [("any_of", list(g)) for g in groups if required]
        rows += [(key, is_list, i, kind, fields) for i, (kind, fields) in enumerate(rules or [("none", [])])]
    return spark.createDataFrame(rows, RULE)


def _judged(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """``artifacts`` with _v (the body as VARIANT, null if it is no JSON), _items (of a list its items, of an object itself) and _bad: structs (index, rule_no, error, fields) of what breaks the contracts.

    A file's rules come to it as one broadcast list, and its items are judged where they stand: no row
    is made or shuffled for an item, a field or a rule.
    """
    rule = F.struct("rule_no", "kind", "fields")
    known = rules.where("kind <> 'none'").groupBy("artifact_key").agg(F.first("is_list").alias("_is_list"), F.array_sort(F.collect_list(rule)).alias("_rules"))
    files = artifacts.withColumn("_v", F.try_parse_json("body")).join(F.broadcast(known), "artifact_key", "left")  # a row for each kind of artifact
    files = files.withColumn("_list", F.try_variant_get("_v", "$", "array<variant>"))
    files = files.withColumn("_items", F.coalesce("_list", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.array("_v"))))
    record = lambda index, no, error, fields: F.struct(index.cast("long").alias("index"), no.cast("int").alias("rule_no"), error.alias("error"), fields.cast("array<string>").alias("fields"))
    none = F.lit(None)
    one = lambda index, error: F.array(record(index, none, F.lit(error), none))

    def filled(value: Column) -> Column:
        """Null for a field that isn't there. A null and a blank text are empty, lists and objects are not."""
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.when(value.isNotNull(), ~F.is_variant_null(value) & (F.coalesce(F.trim(text) != "", F.lit(True))))

    def judged(item: Column, index: Column) -> Column:
        def broken(fields: Column) -> Column:
            of = lambda r: F.transform(r["fields"], lambda f: filled(F.try_element_at(fields, f)))
            error = lambda r, ok: F.when(r["kind"] == "any_of", "missing_alternative_field").when(F.exists(ok, lambda x: x.isNotNull()), "empty_field").otherwise("missing_field")
            each = F.transform("_rules", lambda r: F.transform(F.array(of(r)), lambda ok: F.when(~F.exists(ok, lambda x: F.coalesce(x, F.lit(False))), record(index, r["rule_no"], error(r, ok), r["fields"])))[0])
            return F.filter(each, lambda x: x.isNotNull())

        fields = F.when(F.schema_of_variant(item).startswith("OBJECT"), F.try_variant_get(item, "$", "map<string,variant>"))
        return F.transform(F.array(fields), lambda m: F.when(m.isNull(), one(index, "invalid_item_type")).otherwise(broken(m)))[0]

    items = F.when(F.col("_is_list"), F.flatten(F.transform("_list", judged))).otherwise(judged(F.col("_v"), F.lit(0)))
    whole = F.when(F.col("_v").isNull(), one(none, "json_parse_error")).when(F.col("_is_list") & F.col("_list").isNull(), one(none, "unexpected_type"))
    return files.withColumn("_bad", F.when(F.col("_rules").isNotNull(), F.coalesce(whole, items)))


def violations(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, artifact_key, index, rule_no, error, fields): what breaks the contracts.

    ``artifacts`` has file_id (unique), artifact_key and body (JSON). Errors: json_parse_error and
    unexpected_type (of a file: no index), invalid_item_type, missing_field, empty_field and
    missing_alternative_field (of an item). A null body is no JSON. Null and blank texts are empty,
    empty lists and objects are not. Artifacts without rules have no errors, whatever they hold.
    """
    return _judged(artifacts, rules).select("file_id", "artifact_key", F.explode("_bad").alias("_b")).select("file_id", "artifact_key", "_b.index", "_b.rule_no", "_b.error", "_b.fields")


def schema_report(artifacts: DataFrame, rules: DataFrame, critical: list[str] = CRITICAL) -> DataFrame:
    """One row for each expected artifact of each run: whether it is valid, skipped (and why), its errors and number of records.

    ``artifacts`` has file_id, run_id, artifact_key, file_name and body, and ``present`` (false: the
    run should have the file and doesn't). A missing file is an error for critical artifacts only;
    files other than JSON and artifacts without a contract are skipped as valid.
    """
    known = rules.select("artifact_key", F.lit(True).alias("_known")).distinct()
    rows = artifacts.join(F.broadcast(known), "artifact_key", "left")
    why = F.when(F.col("_known").isNull(), "no_schema_registered").when(~F.lower("file_name").endswith(".json"), "unsupported_artifact_format").when(~F.col("present"), "missing_optional_artifact")
    lacking = (F.col("_known").isNotNull()) & F.lower("file_name").endswith(".json") & ~F.col("present") & F.col("artifact_key").isin(list(critical))
    rows = rows.withColumn("skip_reason", F.when(~lacking, why))
    asked = F.col("skip_reason").isNull() & F.col("present")
    judged = _judged(rows.withColumn("body", F.when(asked, F.col("body"))), rules)
    out = judged.withColumn("_bad", F.when(asked, F.col("_bad"))).withColumns({
        "n_errors": F.when(lacking, F.lit(1)).otherwise(F.coalesce(F.array_size("_bad"), F.lit(0))).cast("long"),
        "errors": F.when(lacking, F.array(F.lit("file_not_found"))).otherwise(F.coalesce(F.array_sort(F.array_distinct(F.col("_bad.error"))), F.array().cast("array<string>"))),
        "skipped": F.col("skip_reason").isNotNull(),
        "record_count": F.when(asked, F.array_size("_items")),
    })
    return out.select("run_id", "file_id", "artifact_key", "file_name", F.lit(VERSION).alias("schema_version"), (F.col("n_errors") == 0).alias("valid"), "skipped", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"), "n_errors", "errors", "record_count")


def report_summary(report: DataFrame) -> DataFrame:
    """Per run: artifacts checked, valid, invalid and skipped by reason, in one aggregation."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return report.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_artifacts_checked"), n(F.col("valid") & ~F.col("skipped"), "valid"), n(~F.col("valid"), "invalid"), n(F.col("skipped") | F.array_contains("errors", "file_not_found"), "skipped"),
        n((F.col("skip_reason") == "missing_optional_artifact") | F.array_contains("errors", "file_not_found"), "skipped_missing"), n(F.col("skip_reason") == "no_schema_registered", "skipped_no_schema"),
        n(F.col("skip_reason") == "unsupported_artifact_format", "skipped_unsupported_format"),
    )


def validation_notifications(report: DataFrame, critical: list[str] = CRITICAL) -> DataFrame:
    """(run_id, notification_id, severity, stage, issue_id, title, message, artifact_refs): a warning for each invalid critical artifact."""
    bad = report.where(F.col("artifact_key").isin(list(critical)) & ~F.col("valid"))
    title = F.concat(F.lit("Schema validation failed for critical artifact '"), "artifact_key", F.lit("'"))
    identity = F.concat_ws("|", "run_id", F.lit("SCHEMA-001"), "artifact_key", F.col("file_id").cast("string"))
    return bad.select("run_id", F.concat(F.lit("notif_"), F.substring(F.sha1(identity), 1, 12)).alias("notification_id"), F.lit("warning").alias("severity"), F.lit("schema_validation").alias("stage"), F.lit("SCHEMA-001").alias("issue_id"), title.alias("title"), F.array_join("errors", "; ").alias("message"), F.array("artifact_key").alias("artifact_refs"))
