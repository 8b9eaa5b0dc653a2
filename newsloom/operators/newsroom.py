"""The story side: sections, assets, posts, related history, model judgments, reviews, artifacts by stage.

Stories have story_id, title, summary, theme_section, status, story_score and source_urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators import events
from newsloom.operators import rules as R
from newsloom.operators.selection import top_per_group

# Public labels by status.
PUBLIC_LABELS = {
    "verified": ["已核实"], "likely": ["证据支持"], "credible_rumor": ["流言", "可信爆料"], "weak_rumor": ["流言", "待验证"], "unverified_rumor": ["流言", "未验证"], "rumor": ["流言", "未验证"], "conflict": ["待核查"],
    "manual_review_required": ["待核查"], "reject": ["不采用"], "unchecked": ["待核查"],
}
UNKNOWN_LABELS = ["待核查"]
# Words that name games and studios in past items.
HISTORY_ENTITIES = {
    "nintendo": ["nintendo", "switch", "mario", "zelda", "pokémon", "splatoon", "animal crossing"],
    "playstation": ["playstation", "ps5", "ps4", "sony", "naughty dog", "insomniac", "santa monica"],
    "xbox": ["xbox", "microsoft", "bethesda", "halo", "forza", "starfield"],
    "pc": ["steam", "epic games", "gog", "valve", "pc gaming"],
    "mobile": ["ios", "android", "mobile game", "gacha", "honkai", "genshin"],
    "esports": ["esports", "league of legends", "lol esports", "dota 2", "valorant champions", "cs:go"],
}
SECTIONS = [*R.SECTIONS, R.SUPPLEMENTAL]


def story_section(title: Column, text: Column, given: Column) -> Column:
    """A given section that exists, else the first that the title names, else the only one that all of the text names, else supplemental."""
    low, whole = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    found = fn.reasons(*((fn.any_contained(words, whole), s) for s, words in R.SECTIONS.items()))
    by_title = F.coalesce(*(F.when(fn.any_contained(words, low), s) for s, words in R.SECTIONS.items()))
    only = F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
    return F.coalesce(F.when(fn.clean(given).isin(SECTIONS), fn.clean(given)), by_title, only, F.lit(R.SUPPLEMENTAL))


def theme_sections(given: Column, entry_themes: Column, entry_theme: Column, section_theme: Column, classified: Column) -> Column:
    """The sections a candidate may stand in: its own, else those that its source's entries name, else the one it is classified as."""
    named = F.concat(F.coalesce(entry_themes, F.array().cast("array<string>")), F.array(entry_theme, section_theme))
    held = F.array_distinct(F.filter(F.transform(named, fn.clean), lambda s: s.isin(SECTIONS)))
    return F.when(fn.clean(given).isin(SECTIONS), F.array(fn.clean(given))).when(F.size(held) > 0, held).otherwise(F.array(classified))


def story_assets(stories: DataFrame, assets: DataFrame) -> DataFrame:
    """(story_id, source_url, url, status, asset_no): the assets of a story's source URLs, each (source_url, url) once.

    Assets have source_url, url, status and asset_no, their order; stories meet them by URL, when repeats are gone.
    """
    return _story_urls(stories).join(_first_assets(assets), "source_url").select("story_id", "source_url", "url", "status", "asset_no")


def _story_urls(stories: DataFrame) -> DataFrame:
    return stories.select("story_id", F.explode(F.array_distinct("source_urls")).alias("source_url")).distinct()


def _first_assets(assets: DataFrame) -> DataFrame:
    """The first asset of each (source_url, url)."""
    return assets.groupBy("source_url", "url").agg(F.min_by("status", "asset_no").alias("status"), F.min("asset_no").alias("asset_no"))


def public_labels(status: Column) -> Column:
    table = F.create_map(*(x for k, v in PUBLIC_LABELS.items() for x in (F.lit(k), F.array(*(F.lit(y) for y in v)))))
    return F.coalesce(F.try_element_at(table, status), F.array(*(F.lit(y) for y in UNKNOWN_LABELS)))


def platform_posts(stories: DataFrame, assets: DataFrame) -> DataFrame:
    """One post per story that is not rejected: labels, whether it must be reviewed, whether a picture is there. Stories have internal_status."""
    pictured = _first_assets(assets).where("status = 'available'").select("source_url").distinct()
    held = _story_urls(stories).join(pictured, "source_url", "left_semi").select("story_id", F.lit(True).alias("_has")).distinct()
    s = stories.where(F.coalesce("status", F.lit("")) != "rejected").join(held, "story_id", "left").withColumn("public_labels", public_labels(F.col("internal_status")))
    review = F.arrays_overlap("public_labels", F.array(F.lit("流言"), F.lit("待核查")))
    text = F.array_join(F.transform("public_labels", lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")
    return s.select(
        "story_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("未命名资讯")).alias("title"), F.when(review, "needs_review").otherwise(F.coalesce("status", F.lit("ready"))).alias("publish_status"), "public_labels",
        text.alias("public_label_text"), F.when(F.col("_has"), "available").otherwise("manual_fill_required").alias("asset_status"), "story_score", "source_urls",
    )


def history_entities(text: Column) -> Column:
    """The known words in a text, in order of the table, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(fn.reasons(*((F.contains(low, F.lit(w)), w) for words in HISTORY_ENTITIES.values() for w in words)))


def historical_context(stories: DataFrame, past: DataFrame, current_year: int, lookback_years: int = 5, max_items: int = 8) -> DataFrame:
    """(story_id, past_id, rank): the latest past items that share an entity or event type with a story.

    Past items have past_id, title, published_at. A past title's words of both tables are its keys, so
    items meet stories by an equi-join on them; stories without a known entity look for up to five of
    their title's words of four letters and more. A key keeps its latest items only, as no story shows more.
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    kinds = F.filter(events.history_types(title), lambda t: t != "general")
    keys = lambda known: F.concat(F.transform(known, lambda e: F.concat(F.lit("e:"), e)), F.transform(kinds, lambda t: F.concat(F.lit("t:"), t)))
    words = F.slice(F.filter(F.split(F.trim(F.regexp_replace(title, r"[^\w]+", " ")), " "), lambda w: F.length(w) > 3), 1, 5)
    known = history_entities(F.concat_ws(" ", "title", "summary"))
    asked = stories.select("story_id", F.explode(F.array_distinct(keys(F.when(F.size(known) > 0, known).otherwise(words)))).alias("key"))
    named = F.array_union(history_entities(F.col("title")), F.filter(F.split(F.trim(F.regexp_replace(title, r"[^\w]+", " ")), " "), lambda w: F.length(w) > 3))
    dated = past.where(F.year("published_at") >= current_year - lookback_years)
    index = dated.select("past_id", "published_at", F.explode(F.array_distinct(keys(named))).alias("key"))
    latest = top_per_group(index, "key", [F.desc("published_at"), F.col("past_id")], max_items, "_n").drop("_n")
    pairs = asked.join(latest, "key").select("story_id", "past_id", "published_at").distinct()
    return top_per_group(pairs, "story_id", [F.desc("published_at"), F.col("past_id")], max_items).select("story_id", "past_id", "rank")


# What a judgment may say.
GAME_RELEVANCE = ["core_game_news", "platform_or_pc_game_adjacent", "community_game_meme", "off_topic", "unknown"]
PUBLISHABILITY = ["publishable", "needs_human_review", "reject"]
HEAT_VALIDITY = ["game_discussion", "general_social_heat", "unclear"]


def parsed_judgments(results: DataFrame, response: str = "raw_response") -> DataFrame:
    """Adds parse_status, game_relevance, publishability, heat_validity, confidence and reason of a model's JSON.

    A fence around the JSON and a comma before a closing bracket are mended (ok_repaired); what is no
    object then is invalid_json and, as values that are not allowed, falls back to unknown, a human
    review and unclear. A judgment without relevance or publishability is fallback_inconsistent.
    """
    schema = "game_relevance string, publishability string, heat_validity string, confidence double, reason string"
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    raw = strip(F.coalesce(F.col(response), F.lit("")))
    mended = F.regexp_replace(strip(F.regexp_replace(raw, r"^```(?:json)?|```$", "")), r",\s*([}\]])", "$1")
    read = lambda c: F.when(F.startswith(c, F.lit("{")) & F.endswith(c, F.lit("}")) & F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    df = results.withColumns({"_a": read(raw), "_b": read(mended)})
    df = df.withColumn("_j", F.coalesce("_a", "_b"))
    j = F.col("_j")
    choice = lambda name, allowed, default: F.when(j[name].isin(allowed), j[name]).otherwise(F.lit(default))
    lacking = j["game_relevance"].isNull() | j["publishability"].isNull()
    status = F.when(j.isNull(), "invalid_json").when(lacking, "fallback_inconsistent").when(F.col("_a").isNotNull(), "ok").otherwise("ok_repaired")
    good = j.isNotNull() & ~lacking
    publish = choice("publishability", PUBLISHABILITY, "needs_human_review")
    return df.withColumns({
        "parse_status": status, "game_relevance": F.when(good, choice("game_relevance", GAME_RELEVANCE, "unknown")).otherwise("unknown"),
        "publishability": F.when(~good & (publish == "publishable"), "needs_human_review").otherwise(F.coalesce(publish, F.lit("needs_human_review"))),
        "heat_validity": F.when(good, choice("heat_validity", HEAT_VALIDITY, "unclear")).otherwise("unclear"),
        "confidence": F.least(F.greatest(F.coalesce(j["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), "reason": F.substring(F.coalesce(j["reason"], F.lit("")), 1, 500),
    }).drop("_a", "_b", "_j")


def reviews_of(reviews: DataFrame, story_id: str | None = None, decision: str | None = None, limit: int = 50) -> DataFrame:
    """The reviews of (review_id, story_id, decision, created_at), the latest first, ``limit`` at most."""
    held = reviews
    for name, value in (("story_id", story_id), ("decision", decision)):
        if value is not None:
            held = held.where(F.col(name) == value)
    return held.orderBy(F.desc("created_at"), F.desc("review_id")).limit(limit)


def latest_decisions(reviews: DataFrame) -> DataFrame:
    """(story_id, decision, n_reviews): each story's last decision."""
    return reviews.groupBy("story_id").agg(F.max_by("decision", F.struct("created_at", "review_id")).alias("decision"), F.count(F.lit(1)).alias("n_reviews"))


def artifacts_by_stage(artifacts: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """(stage, expected, present, missing): which of each stage's files a table of file_name has; a file of no stage is in ``other``."""
    names = [(s, f) for s, fs in stages.items() for f in fs]
    table = F.create_map(*(F.lit(x) for s, f in names for x in (f, s)))
    of = artifacts.select(F.col("file_name"), F.coalesce(F.try_element_at(table, F.col("file_name")), F.lit("other")).alias("stage")).distinct()
    have = of.groupBy("stage").agg(F.sort_array(F.collect_set(F.when(F.col("stage") != "other", F.col("file_name")))).alias("have"), F.count(F.lit(1)).alias("present"))
    want = artifacts.sparkSession.range(1).select(F.explode(F.create_map(*(x for s, fs in stages.items() for x in (F.lit(s), F.array(*(F.lit(f) for f in fs)))))).alias("stage", "files"))
    both = want.join(have, "stage", "full_outer")
    none = F.array().cast("array<string>")
    return both.select("stage", F.size(F.coalesce("files", none)).alias("expected"), F.coalesce("present", F.lit(0)).alias("present"), F.array_except(F.coalesce("files", none), F.coalesce("have", none)).alias("missing"))


# The forms of a notification's ids and its allowed values.
SEVERITIES, STATES = ["info", "warning", "needs_user_action", "blocking"], ["open", "acknowledged", "resolved"]


def _shape(c: str) -> Column:
    """The type of a column's JSON; VOID for none."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit("VOID"))


def _told(items: Column, said: Column) -> Column:
    """``said`` with the place of each item (kind, i) that is no text."""
    return F.transform(F.filter(items, lambda x: x["kind"] != "STRING"), lambda x: F.concat(said, x["i"].cast("string"), F.lit("]")))


def notification_issues(notifications: DataFrame, required: tuple[str, ...] = ("notification_id", "issue_id", "stage", "severity", "status", "title", "message")) -> DataFrame:
    """(notification_id, issue): what breaks a notification's contract, a row for each. ``required`` columns may not be null.

    Where there are columns suggested_actions, artifact_refs (JSON) and details (JSON), the first two have to be lists of
    texts, by place, and the last an object; a null one is left out.
    """
    blank = lambda c: fn.clean(F.col(c)) == ""
    found = fn.reasons(
        *((F.col(c).isNull(), f"missing:{c}") for c in required),
        (F.col("notification_id").isNotNull() & ~F.col("notification_id").rlike("^notif_[0-9a-f]{12}$"), "malformed:notification_id"), (F.col("severity").isNotNull() & ~F.col("severity").isin(SEVERITIES), "invalid:severity"),
        (F.col("status").isNotNull() & ~F.col("status").isin(STATES), "invalid:status"), (F.col("issue_id").isNotNull() & ~F.col("issue_id").rlike("^[A-Z]{2,5}-[0-9]{3,}$"), "malformed:issue_id"),
        *((F.col(c).isNotNull() & blank(c), f"blank:{c}") for c in ("stage", "title", "message")),
        *((F.col(c).isNotNull() & ~_shape(c).startswith("ARRAY"), f"not_a_list:{c}") for c in ("suggested_actions", "artifact_refs") if c in notifications.columns),
        *((F.col(c).isNotNull() & ~_shape(c).startswith("OBJECT"), f"not_an_object:{c}") for c in ("details",) if c in notifications.columns),
    )
    for c in ("suggested_actions", "artifact_refs"):
        if c in notifications.columns:
            items = F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"), F.array().cast("array<variant>"))
            told = F.lit(f"not_a_text:{c}[")
            odd = F.transform(items, lambda v, i: F.struct(F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("kind"), i.alias("i")))
            found = F.concat(found, _told(odd, told))
    return notifications.select("notification_id", F.explode(found).alias("issue"))
