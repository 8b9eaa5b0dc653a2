"""Events in time: bursts, timelines, gaps of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom import functions as fn

# Patterns of live events, in order.
LIVE_EVENTS = {
    "livestream": "直播|live broadcast|livestream|实况|试玩直播|前瞻直播|特别节目|special program|全程直播",
    "press_conference": "发布会|直面会|direct|showcase|state of play|gamescom|tgs|东京电玩展|e3|tga|the game awards|科隆|chinajoy|cj展|games award",
    "game_festival": "游戏节|游戏展|嘉年华|festival|fest|游戏展会|试玩活动|play day|preview event|开放日|summer game fest|夏日游戏节",
    "beta_or_demo": "试玩|demo|beta|公测|内测|体验版|测试.*上线|playtest|early access.*上|抢先体验",
    "patch_day": "赛季|更新.*上线|新版本|大型更新|资料片|expansion|dlc.*上线|第.*季|season",
}
# Patterns of event types of a story, in order, and the types that follow from a candidate's type.
EVENT_TYPES = {
    "confirmed_report": r"已上线|正式上线|推送上线|公布|发布|发售|定档|确认|宣布|官方宣布|公开|正式公开|\b(confirmed|revealed|announced)\b",
    "community_reaction": "热议|争议|走红|疯传|转发|玩家反应|客服|补偿|梗|整活|离谱|投票|评论区|火了|刷屏",
    "review_or_score": "评分|评测|评分解禁|m站|metacritic|opencritic|review score|媒体评分|斩获.*分|获得.*分|高分|低分",
    "price_or_market": r"售价|涨价|降价|价格|销量|首周|定价|股价|暴涨|暴跌|\b(price|pricing|sale figure|revenue)\b",
    "leak_or_rumor": r"爆料|泄露|传闻|据称|有望|曝光|\b(leak|rumor)\b",
    "patch_or_update": r"更新|补丁|新版本|赛季更新|\b(patch|update|hotfix)\b|上线更新|新增内容",
    "release_or_launch": "发售|解锁|预载|上线|推出|登陆|launch|已登陆|即将登陆",
    "development": r"开发|制作人|主创|工作室|团队|开发进展|\b(developer|studio update)\b",
}
CORRECTIONS = ["更正", "纠正", "修正", "澄清", "辟谣", "correction", "correct", "clarify"]
TYPE_EVENTS = {"rumor": "leak_or_rumor", "review_score": "review_or_score", "platform_price": "price_or_market"}
# Keywords of event types of past items; several may hold.
HISTORY_TYPES = {
    "launch": ["launch", "release date", "released", "now available", "out now"],
    "update": ["update", "patch", "hotfix", "season", "dlc", "expansion"],
    "delay": ["delay", "delayed", "postponed", "pushed back"],
    "shutdown": ["shutdown", "sunset", "end of service", "closing", "discontinued"],
    "acquisition": ["acquisition", "acquired", "merged", "bought"],
    "controversy": ["controversy", "backlash", "outrage", "criticism", "boycott"],
    "award": ["award", "game of the year", "goty", "nomination", "won"],
    "record": ["record", "milestone", "broke", "fastest", "highest", "best-selling"],
}


def event_type(text: Column, candidate_type: Column) -> Column:
    """The first type whose pattern is in the text, else what the candidate's type says, else general_news."""
    return fn.first_match([*((fn.matches(p, text), name) for name, p in EVENT_TYPES.items()), *((candidate_type == k, v) for k, v in TYPE_EVENTS.items())], "general_news")


def history_types(text: Column) -> Column:
    """All types of which a keyword stands in the text, in order; ["general"] if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = fn.reasons(*((fn.any_contained(words, low), name) for name, words in HISTORY_TYPES.items()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def bursts(items: DataFrame, entity: str, ts: str, ordinal: str, hours: float = 72, least: int = 3) -> DataFrame:
    """Bursts of items of one entity: (entity, burst, story_count, started_at, ended_at, duration_hours).

    An item starts a range if ``least`` or more items, itself first, lie within ``hours`` after it;
    ranges that share an item are one burst. Rows without a time or an entity take no part.
    """
    items = items.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    by = W.partitionBy(entity).orderBy("_us", ordinal)
    items = items.withColumn("_n", F.row_number().over(by))
    # rows up to the last item within the window; ties behind the row count, ties before it do not
    last = F.max("_n").over(W.partitionBy(entity).orderBy("_us").rangeBetween(0, int(hours * 3_600_000_000)))
    ranges = items.withColumn("_end", last + 1)
    ranges = ranges.withColumn("_start", F.col("_end") - F.col("_n") >= least)
    reach = F.max(F.when(F.col("_start"), F.col("_end"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.withColumn("_reach", F.coalesce(reach, F.lit(0)))
    # a row begins a burst if it starts a range and no earlier range reaches it; it belongs to one if a range covers it
    begins = F.col("_start") & (F.col("_n") >= F.col("_reach"))
    ranges = ranges.withColumn("burst", F.sum(F.when(begins, 1).otherwise(0)).over(by)).where(F.col("_start") | (F.col("_n") < F.col("_reach")))
    out = ranges.groupBy(entity, "burst").agg(F.count(F.lit(1)).alias("story_count"), F.min("_us").alias("a"), F.max("_us").alias("b"))
    return out.select(entity, "burst", "story_count", F.timestamp_micros("a").alias("started_at"), F.timestamp_micros("b").alias("ended_at"), F.round((F.col("b") - F.col("a")) / 3.6e9, 1).alias("duration_hours"))


def live_type(text: Column) -> Column:
    return fn.first_match([(fn.matches(p, text), name) for name, p in LIVE_EVENTS.items()], "story_burst")


def timeline(items: DataFrame, key: list[str], ts: str, ordinal: str) -> DataFrame:
    """Adds chronological_index (from 0), entry_count and entry_label to the items of each event key.

    Items without a time come first, as at 2000-01-01. Labels need is_correction and is_official.
    """
    at = F.coalesce(F.col(ts), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    by = W.partitionBy(*key).orderBy(at, ordinal)
    items = items.withColumn("chronological_index", F.row_number().over(by) - 1).withColumn("entry_count", F.count(F.lit(1)).over(W.partitionBy(*key)))
    seen = F.coalesce(F.max(F.col("is_official").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    label = fn.first_match(
        [(F.col("is_correction"), "correction"), (F.col("chronological_index") == 0, "initial_report"), (F.col("is_official"), "official_confirmation"), (seen, "reaction")], "new_detail"
    )
    return items.withColumn("entry_label", label)


def cluster_timelines(clusters: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(timelines, entries) of story clusters with their claims: clusters of the same entities and event type are one event.

    Clusters have story_cluster_id, canonical_title, entity_signatures, source_urls, candidate_count and
    may lack, or have null, candidate_type, observed_at, published_at, heat_score, discussion_score and
    tags; those then come from the first claim (by claim_no) of the story. Claims have story_id, claim_no
    and those fields. A cluster without a time stands first, as at 2000-01-01; ties by cluster id. An
    event's rows meet in windows by event key, which hold the clusters of one set of entities.
    """
    fields = {"candidate_type": "string", "observed_at": "timestamp", "published_at": "timestamp", "heat_score": "double", "discussion_score": "double", "tags": "array<string>"}
    typed = lambda df: df.withColumns({c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in fields.items()})
    told = typed(claims).where(fn.clean(F.col("story_id")) != "").groupBy(F.col("story_id").alias("story_cluster_id")).agg(F.count(F.lit(1)).alias("claim_count"), F.min_by(F.struct(*fields), F.struct("claim_no", "claim_id")).alias("_m"))
    named = [c for c in ("title", "snippet", "game_title") if c in clusters.columns]
    rows = typed(clusters).join(told, "story_cluster_id", "left")
    empty = {"string": lambda x: F.nullif(x, F.lit("")), "double": lambda x: F.nullif(x, F.lit(0.0)), "array<string>": lambda x: F.when(F.size(x) > 0, x), "timestamp": lambda x: x}
    rows = rows.withColumns({c: F.coalesce(empty[t](F.col(c)), F.col(f"_m.{c}")) for c, t in fields.items()}).withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))
    rows = rows.withColumns({"candidate_type": F.coalesce("candidate_type", F.lit("news")), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    text = F.concat_ws(" ", *named, "canonical_title", "candidate_type")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("entity_signatures", F.array().cast("array<string>")), lambda e: F.lower(F.trim(e))), lambda e: e != "")))
    rows = rows.withColumns({"event_type": event_type(text, F.col("candidate_type")), "_names": names})
    key = F.concat(F.lit("ev:"), F.when(F.size("_names") > 0, F.substring(F.sha1(F.array_join("_names", "|").cast("binary")), 1, 16)).otherwise("no_entity"), F.lit(":"), "event_type")
    low = F.lower(F.coalesce("canonical_title", F.lit("")))
    corrected = fn.any_contained(CORRECTIONS, low) | (F.size(F.array_intersect(F.transform("tags", F.lower), F.array(*map(F.lit, CORRECTIONS)))) > 0)
    rows = rows.withColumns({"event_key": key, "at": F.coalesce("observed_at", "published_at"), "is_correction": corrected})
    order = W.partitionBy("event_key").orderBy(F.coalesce("at", F.lit("2000-01-01 00:00:00").cast("timestamp")), "story_cluster_id")
    rows = rows.withColumn("chronological_index", (F.row_number().over(order) - 1).cast("int"))
    label = fn.first_match([
        (F.col("is_correction"), "correction"), (F.col("chronological_index") == 0, "initial_report"), ((F.col("event_type") == "confirmed_report") & (F.col("candidate_type") == "news"), "official_confirmation"), (F.col("event_type") == "community_reaction", "reaction"),
    ], "new_detail")
    entries = rows.withColumn("event_label", label).select(
        fn.short_hash(F.col("event_key")).alias("event_id"), "event_key", "story_cluster_id", "chronological_index", "event_label", "canonical_title", "entity_signatures", "source_urls", "candidate_count", "candidate_type", "event_type", "observed_at", "published_at",
        F.coalesce("heat_score", F.lit(0.0)).alias("heat_score"), F.coalesce("discussion_score", F.lit(0.0)).alias("discussion_score"), "claim_count", "is_correction", "at",
    )
    first = F.struct("chronological_index", "entity_signatures")
    g = entries.groupBy("event_id", "event_key").agg(
        F.count(F.lit(1)).alias("entry_count"), F.min_by("at", "chronological_index").alias("started_at"), F.max_by("at", "chronological_index").alias("last_updated_at"), F.min(first).alias("_f"), F.first("event_type").alias("event_type"), F.bool_or("is_correction").alias("has_correction")
    )
    official = F.col("event_type") == "confirmed_report"
    two = F.array_join(F.slice(F.array_distinct(F.coalesce("_f.entity_signatures", F.array().cast("array<string>"))), 1, 2), " / ")
    label_ = F.concat(F.when(two == "", F.lit("未识别游戏")).otherwise(two), F.when(official, F.lit(" — 官方动态时间线")).otherwise(F.lit(" — 事件时间线")))
    timelines = g.select("event_id", "event_key", label_.alias("timeline_label"), "started_at", "last_updated_at", "entry_count", official.alias("has_official_confirmation"), (F.col("event_type") == "community_reaction").alias("has_community_reaction"), "has_correction", "event_type")
    return timelines, entries.drop("is_correction", "at")


def year_gaps(items: DataFrame, key: str, year: str, current_year: int, least: int = 2) -> DataFrame:
    """(key, pattern, from_year, to_year): first_since_year to now, resumed_after_gap between years that follow."""
    years = items.where(F.col(key).isNotNull() & F.col(year).isNotNull()).select(key, F.col(year).alias("y")).distinct()
    gaps = years.withColumn("before", F.lag("y").over(W.partitionBy(key).orderBy("y"))).where(F.col("y") - F.col("before") >= least)
    resumed = gaps.select(key, F.lit("resumed_after_gap").alias("pattern"), F.col("before").alias("from_year"), F.col("y").alias("to_year"))
    latest = years.groupBy(key).agg(F.max("y").alias("y")).where(current_year - F.col("y") >= least)
    return resumed.unionByName(latest.select(key, F.lit("first_since_year").alias("pattern"), F.col("y").alias("from_year"), F.lit(current_year).cast("int").alias("to_year")))
