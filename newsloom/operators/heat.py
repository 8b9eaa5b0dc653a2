"""Heat observations of any provider in one shape: field paths are data, not columns.

A provider's raw observation is JSON of its own shape. A mapping table says for each provider which
raw field feeds which unified field, and its default. Raw fields are exploded, meet the mapping by an
equi-join and are pivoted back, so all providers go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators.social import ACCESS_MODES

# Fields of an observation, and words that show talk of games and any discussion.
REQUIRED = ["engagement_signals", "platform", "result_type", "snippet", "timestamp", "url"]
TEXT_FIELDS = ["platform", "result_type", "url", "snippet", "timestamp"]
JSON_FIELDS = ["engagement_signals", "evidence_texts", "top_results"]
PLAIN_FIELDS = ["candidate_id", "candidate_url", "candidate_title", "query"]
GAME_WORDS = ["game", "games", "gaming", "playstation", "ps5", "ps4", "xbox", "nintendo", "switch", "steam", "pc", "trailer", "release", "demo", "玩家", "游戏", "主机", "任天堂", "索尼", "微软", "发售", "预告", "新作", "单机", "电玩"]
TALK_WORDS = ["comment", "comments", "reply", "replies", "repost", "reposts", "share", "shares", "discussion", "discuss", "debate", "thread", "trending", "评论", "弹幕", "转发", "热议", "讨论", "争议", "帖子", "播放"]
HINTS = ["game_discussion", "general_social_heat", "unclear"]

MAPPING = "provider_id string, field string, source string, default_value string"


def mapping(spark: SparkSession, providers: list[dict]) -> DataFrame:
    """(provider_id, field, source, default_value) from contracts {provider_id, output_schema: {field: name or {source, default}}}.

    A field that a contract does not map is read under its own name.
    """
    rows = []
    for p in providers:
        declared = p.get("output_schema") or {}
        for f in dict.fromkeys([*TEXT_FIELDS, *JSON_FIELDS, *PLAIN_FIELDS, *declared]):
            m = declared.get(f)
            m = m if isinstance(m, dict) else {}
            rows.append((p["provider_id"], f, str(m.get("source", f)), None if m.get("default") is None else str(m["default"])))
    return spark.createDataFrame(rows, MAPPING)


def providers(spark: SparkSession, contracts: list[dict]) -> DataFrame:
    """(provider_id, provider_platform, access_method), the method brought to the known ones."""
    rows = []
    for p in contracts:
        mode = str(p.get("access_method", "public_search")).strip().lower()
        rows.append((p["provider_id"], str(p.get("platform") or "unknown").strip(), mode if mode in ACCESS_MODES else "api_or_search_service" if mode == "api" else "public_search"))
    return spark.createDataFrame(rows, "provider_id string, provider_platform string, access_method string")


def validity_hint(texts: Column, title: Column, query: Column, engaged: Column) -> Column:
    """game_discussion, general_social_heat or unclear: by words of the evidence without the candidate's own title and query."""
    t = F.coalesce(texts, F.lit(""))
    for own in (title, query):
        t = F.when(fn.clean(own) != "", F.replace(t, fn.clean(own), F.lit(" "))).otherwise(t)
    low = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    talk = fn.any_contained(TALK_WORDS, low) | engaged
    return F.when(fn.any_contained(GAME_WORDS, low) & talk, HINTS[0]).when(talk, HINTS[1]).otherwise(HINTS[2])


def normalized(raw: DataFrame, maps: DataFrame, who: DataFrame, now: Column) -> DataFrame:
    """Observations (obs_id, provider_id, body: JSON) of all providers in the unified shape, one row each.

    A body that is no JSON object gives the defaults. A raw field that is null counts as not there.
    extra holds the mapped fields beyond the unified ones. ``maps`` and ``who`` have a row for each
    field and each provider of a contract; an observation of an unknown provider is read by field name.
    """
    spark = raw.sparkSession
    parsed = raw.select("obs_id", "provider_id", F.try_parse_json("body").alias("v"))
    objects = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("source"), F.col("value").alias("value")))
    shown = F.when(F.schema_of_variant("value") == "VOID", None).when(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"), F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    fields = fields.select("obs_id", "provider_id", "source", shown.alias("value"))
    every = [*TEXT_FIELDS, *JSON_FIELDS, *PLAIN_FIELDS]
    plain = raw.select("provider_id").distinct().join(maps.select("provider_id").distinct(), "provider_id", "left_anti")
    own = plain.select("provider_id", F.explode(F.array(*map(F.lit, every))).alias("field")).select("provider_id", "field", F.col("field").alias("source"), F.lit(None).cast("string").alias("default_value"))
    maps = maps.unionByName(own)
    placed = fields.join(maps, ["provider_id", "source"]).where("value is not null")
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}")
    extra = F.map_from_entries(F.array_sort(F.collect_set(F.when(~F.col("field").isin(every), F.struct("field", "value"))))).alias("extra")
    wide = placed.groupBy("obs_id").agg(*map(value, every), extra)
    default = maps.where("default_value is not null").groupBy("provider_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "default_value"))).alias("_defaults"))
    rows = raw.select("obs_id", "provider_id").join(who, "provider_id", "left").join(default, "provider_id", "left").join(wide, "obs_id", "left")
    said = lambda f: fn.clean(F.coalesce(F.col(f"_{f}"), F.try_element_at("_defaults", F.lit(f))))
    some = lambda c, *other: F.coalesce(F.nullif(c, F.lit("")), *other)
    signals = F.coalesce(F.from_json(said("engagement_signals"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    texts = F.filter(F.coalesce(F.from_json(said("evidence_texts"), "array<string>"), F.array().cast("array<string>")), lambda t: fn.clean(t) != "")
    results = F.coalesce(F.from_json(said("top_results"), "array<struct<title:string,snippet:string>>"), F.array().cast("array<struct<title:string,snippet:string>>"))
    out = rows.select(
        "obs_id", "provider_id", some(said("platform"), F.col("provider_platform"), F.lit("unknown")).alias("platform"), some(said("result_type"), F.lit("unknown")).alias("result_type"), signals.alias("engagement_signals"),
        said("url").alias("url"), said("snippet").alias("snippet"), some(said("timestamp"), now.cast("string")).alias("timestamp"), F.coalesce("access_method", F.lit("public_search")).alias("access_method"),
        F.transform(texts, F.trim).alias("evidence_texts"), F.filter(results, lambda r: r.isNotNull()).alias("top_results"), *(said(f).alias(f) for f in PLAIN_FIELDS), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
    )
    words = F.array_join(F.concat("evidence_texts", F.flatten(F.transform("top_results", lambda r: F.array(F.coalesce(r["title"], F.lit("")), F.coalesce(r["snippet"], F.lit("")))))), " ")
    engaged = F.exists(F.map_values("engagement_signals"), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0)) > 0)
    return out.withColumn("heat_validity_hint", validity_hint(words, F.col("candidate_title"), F.col("query"), engaged))


def missing_fields(body: Column) -> Column:
    """The required fields that a unified observation in JSON lacks, sorted; all of them where it is no object."""
    v = F.try_parse_json(body)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: fn.clean(F.try_variant_get(v, f"$.{f}", "string"))
    lacking = lambda f: ~F.coalesce(kind(f).startswith("OBJECT"), F.lit(False)) if f == "engagement_signals" else text(f) == ""
    return fn.reasons(*((lacking(f), f) for f in REQUIRED))


def heat_summary(observations: DataFrame) -> DataFrame:
    """(dimension, value, n): every counter of the report from one aggregation over the observations.

    Grouping sets count by platform, access_mode, status and heat_validity_hint, by mode and status
    together, and in all; ``grouping_id`` tells them apart. Named totals are rows of dimension 'total'.
    """
    sets = [["platform"], ["access_mode"], ["status"], ["heat_validity_hint"], ["access_mode", "status"], []]
    dims = ["platform", "access_mode", "status", "heat_validity_hint"]
    g = observations.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    bit = {c: 1 << (len(dims) - 1 - i) for i, c in enumerate(dims)}
    of = lambda s: sum(bit.values()) - sum(bit[c] for c in s)
    is_ = lambda *s: F.col("g") == of(s)
    row = lambda d, v, n: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"), n.cast("long").alias("n"))
    total = lambda name, n=None: row("total", F.lit(name), F.col("n") if n is None else n)
    st = F.col("status")
    made = F.array(
        *(F.when(is_(c), row(c, F.col(c), F.col("n"))) for c in dims),
        F.when(is_(), total("total_observations")),
        F.when(is_("access_mode", "status") & (F.col("access_mode") == "public_search") & (st == "ok"), total("public_search_ok")),
        F.when(is_("status") & (st == "manual_required"), total("manual_required")),
        F.when(is_("status") & st.isin("blocked", "login_required"), total("blocked_or_login_required")),
        F.when(is_("heat_validity_hint") & (F.col("heat_validity_hint") == "game_discussion"), total("game_discussion")),
    )
    return g.select(F.explode(F.array_compact(made)).alias("r")).groupBy("r.dimension", "r.value").agg(F.sum("r.n").alias("n"))


# What an access profile asks for, by probe.
LOGIN_PROBES, BLOCKED_PROBES = ["js_shell", "visitor_system"], ["blocked", "403", "401"]
NEEDS_LOGIN = ["login_required", "blocked", "browser_only", "api_key_required"]


def provider_access(df: DataFrame, login_platforms: list[str]) -> DataFrame:
    """Adds access_status, recommended_method and requires_login to providers (platform, public_http_probe, default_access_mode).

    A provider without a platform is blocked. Providers that need a login are never skipped silently:
    they are marked for manual work or a browser.
    """
    probe, platform = fn.clean(F.col("public_http_probe")), fn.clean(F.col("platform"))
    by_api = fn.clean(F.col("default_access_mode")) == "api_or_search_service"
    row = lambda status, method: F.struct(F.lit(status).alias("access_status"), (method if isinstance(method, Column) else F.lit(method)).alias("recommended_method"))
    manual = "manual_or_browser_required"
    found = (
        F.when(platform == "", row("blocked", manual)).when(probe == "ok", row("public_accessible", "public_search")).when(probe.isin(LOGIN_PROBES), row("login_required", manual))
        .when(probe.isin(BLOCKED_PROBES), row("blocked", F.when(by_api, "api").otherwise(manual))).when(platform.isin(login_platforms), row("login_required", manual)).otherwise(row("public_accessible", "public_search"))
    )
    out = df.withColumn("_a", found).withColumns({"access_status": F.col("_a.access_status"), "recommended_method": F.col("_a.recommended_method")}).drop("_a")
    return out.withColumn("requires_login", F.col("access_status").isin(NEEDS_LOGIN))
