"""The event store as tables: events of stories, games, links of news items, timelines, decision traces.

Every function gives rows keyed as the store keeps them; ``upserted`` lays new rows over old ones. Ids
are digests of what identifies a row, so a run that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn

# Event types and link roles by the story's own.
EVENT_TYPES = {
    "confirmed_report": "announcement", "release_or_launch": "release", "patch_or_update": "update", "community_reaction": "controversy", "leak_or_rumor": "rumor", "price_or_market": "other",
    "review_or_score": "other", "development": "update", "general_news": "other",
}
ROLES = {
    "initial_report": "primary_event", "new_detail": "new_detail", "official_confirmation": "official_confirmation", "reaction": "reaction", "correction": "new_detail", "late_repost": "late_repost",
    "duplicate_report": "duplicate_report",
}


def hash_id(prefix: str, *parts: Column) -> Column:
    return fn.short_hash(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), f"{prefix}_")


def _mapped(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def game_id(title: Column) -> Column:
    """The id of a game's title, lower-cased; empty for an empty title."""
    t = F.lower(fn.clean(title))
    return F.when(t == "", F.lit("")).otherwise(hash_id("g", t))


def events(stories: DataFrame) -> DataFrame:
    """One event per (title, type, game) of stories with a title; of repeated ones the last by ordinal.

    Stories have ordinal, title, event_type, event_label, game_title, source_urls, confidence (0 to
    100), started_at, ended_at, parent_event_id.
    """
    s = stories.where(fn.clean(F.col("title")) != "")
    kind, game = _mapped(F.coalesce("event_type", F.lit("")), EVENT_TYPES, "other"), game_id(F.coalesce(F.nullif(fn.clean(F.col("game_title")), F.lit("")), F.col("title")))
    s = s.withColumns({"kind": kind, "game_id": game, "game": F.lower(fn.clean(F.coalesce(F.nullif(fn.clean(F.col("game_title")), F.lit("")), F.col("title"))))})
    row = F.struct("title", F.col("kind").alias("event_type"), "game_id", "game", "started_at", "ended_at", F.nullif(fn.clean(F.col("parent_event_id")), F.lit("")).alias("parent_event_id"))
    keyed = s.select(hash_id("ev", F.trim("title"), F.col("kind"), F.col("game_id")).alias("event_id"), "ordinal", row.alias("row"))
    return keyed.groupBy("event_id").agg(F.max_by("row", "ordinal").alias("row")).select("event_id", "row.*")


def games(events_: DataFrame) -> DataFrame:
    """(game_id, canonical_title) of the games that events name."""
    return events_.where("game_id <> ''").groupBy("game_id").agg(F.min("game").alias("canonical_title"))


def news_links(stories: DataFrame, news_items: DataFrame) -> DataFrame:
    """(event_id, news_item_id, game_id, role, confidence): each story's URLs that are news items; of repeats the last by ordinal."""
    s = stories.where(fn.clean(F.col("title")) != "")
    kind, game = _mapped(F.coalesce("event_type", F.lit("")), EVENT_TYPES, "other"), game_id(F.coalesce(F.nullif(fn.clean(F.col("game_title")), F.lit("")), F.col("title")))
    role = _mapped(F.coalesce("event_label", F.lit("")), ROLES, "duplicate_report")
    s = s.select(hash_id("ev", F.trim("title"), kind, game).alias("event_id"), game.alias("game_id"), role.alias("role"), (F.coalesce("confidence", F.lit(0.0)) / 100).alias("confidence"), "ordinal", F.explode("source_urls").alias("url"))
    s = s.withColumn("canon", fn.canonical_url(F.col("url"))).where("canon <> ''").withColumn("news_item_id", hash_id("ni", F.col("canon")))
    held = s.join(news_items.select("news_item_id"), "news_item_id", "left_semi")
    return held.groupBy("event_id", "news_item_id").agg(*(F.max_by(c, "ordinal").alias(c) for c in ("game_id", "role", "confidence")))


def game_links(links: DataFrame, match_method: str = "keyword_match") -> DataFrame:
    """(news_item_id, game_id, match_method, confidence) of the links of events that name a game; the surest of each."""
    return links.where("game_id <> ''").groupBy("news_item_id", "game_id").agg(F.lit(match_method).alias("match_method"), F.max("confidence").alias("confidence"))


def link_news_to_game(pairs: DataFrame, match_method: str, confidence: float = 1.0) -> DataFrame:
    """(news_item_id, game_id, match_method, confidence, error) of pairs (news_item_id, game_title); an empty title is an error."""
    g = game_id(F.col("game_title"))
    return pairs.select("news_item_id", g.alias("game_id"), F.lit(match_method).alias("match_method"), F.lit(confidence).alias("confidence"), F.when(g == "", "empty_game_title").alias("error"))


def event_timeline(events_: DataFrame, links: DataFrame, news_items: DataFrame, now: Column, days: int = 90, game: str | None = None) -> DataFrame:
    """Events of the window, newest first, with news_items: their linked items by time.

    Events without a start are kept. News items have news_item_id, title, source_id, published_at.
    """
    kept = events_.where(F.col("started_at").isNull() | (F.col("started_at") >= now - F.make_dt_interval(F.lit(days))))
    if game is not None:
        kept = kept.where(F.col("game_id") == game)
    item = F.struct("published_at", "news_item_id", F.col("n_title").alias("title"), "source_id", "role", "confidence")
    named = links.join(news_items.select("news_item_id", F.col("title").alias("n_title"), "source_id", "published_at"), "news_item_id")
    of = named.groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("news_items"))  # an event's links, not a game's
    out = kept.join(of, "event_id", "left")
    return out.withColumn("news_items", F.coalesce("news_items", F.filter("news_items", lambda x: F.lit(False)), F.array().cast(of.schema["news_items"].dataType)))


def decision_traces(decisions: DataFrame, created_at: Column) -> DataFrame:
    """Rows of the decision log from (run_id, stage, decision_type, input_artifact_refs, output_decision, model_used, prompt_version); maps and arrays become JSON."""
    return decisions.select(
        hash_id("dt", F.col("run_id"), F.col("stage"), F.col("decision_type"), created_at).alias("trace_id"),
        "run_id",
        "stage",
        "decision_type",
        F.to_json(F.coalesce("input_artifact_refs", F.array().cast("array<string>"))).alias("input_artifact_refs"),
        F.to_json(F.coalesce("output_decision", F.create_map().cast("map<string,string>"))).alias("output_decision"),
        F.coalesce("model_used", F.lit("")).alias("model_used"),
        F.coalesce("prompt_version", F.lit("")).alias("prompt_version"),
        created_at.alias("created_at"),
    )


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
