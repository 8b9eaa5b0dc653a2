"""Joins that look for the best few: best historical match, packs of a story's URLs, replacements of a theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom import functions as fn
from newsloom.operators.clusters import duplicate_band

# What URL, title and entities weigh in a score, and the score of one URL at least.
URL_WEIGHT, TITLE_WEIGHT, ENTITY_WEIGHT, SAME_URL = 0.5, 0.35, 0.15, 0.95


def _shape(df: DataFrame, p: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(fn.normalized_title(F.col("title")), " "), lambda t: t != ""))
    url = fn.canonical_url(F.col("url"))
    path = F.array_distinct(fn.tokens(fn.url_path(url)))
    return df.select(F.col("id").alias(f"{p}_id"), url.alias(f"{p}_url"), fn.url_host(url).alias(f"{p}_host"), words.alias(f"{p}_title"), F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))).alias(f"{p}_ent"), path.alias(f"{p}_path"))


def _keys(p: str, least: float) -> Column:
    """What a row can be found by, but for its title: path words on its host and, where a path has no words, its host alone; entities, if those alone make a match."""
    host, path, url = F.col(f"{p}_host"), F.col(f"{p}_path"), F.col(f"{p}_url")
    has, bare, none = url != "", F.size(path) == 0, F.array().cast("array<string>")
    on_host = F.when(has, F.transform(path, lambda t: F.concat(F.lit("p:"), F.concat_ws(" ", host, t)))).otherwise(none)
    # A path without words meets every row of its host; one with words meets those without.
    every, alone = F.when(has, F.concat(F.lit("h:"), host)), F.when(has & bare, F.concat(F.lit("h:"), host))
    hosts = F.array(every, F.when(has & bare, F.concat(F.lit("b:"), host))) if p == "m" else F.array(alone, F.when(has & ~bare, F.concat(F.lit("b:"), host)))
    ents = F.transform(F.col(f"{p}_ent"), lambda t: F.concat(F.lit("e:"), t)) if ENTITY_WEIGHT >= least - 1e-4 else none
    return F.array_compact(F.concat(on_host, hosts, ents))


def _title_keys(df: DataFrame, p: str, often: DataFrame, share: float) -> DataFrame:
    """(id, k): of each title's words, the rarest first, all but the last of which a title with a Jaccard index of ``share`` can't do without."""
    words = df.select(f"{p}_id", F.size(f"{p}_title").alias("_size"), F.explode(f"{p}_title").alias("word")).join(often, "word", "left")
    place = F.row_number().over(W.partitionBy(f"{p}_id").orderBy(F.coalesce("n", F.lit(0)), "word"))
    return words.withColumn("_place", place).where(F.col("_place") <= F.col("_size") - F.ceil(F.col("_size") * max(share, 0.0)) + 1).select(f"{p}_id", F.concat(F.lit("t:"), "word").alias("k"))


def _shared(c: str = "c", m: str = "m") -> dict[str, Column]:
    """How many path words, title words and entities two rows share."""
    return {f"_{x}": F.size(F.array_intersect(f"{c}_{x}", f"{m}_{x}")) for x in ("path", "title", "ent")}


def match_score(c: str = "c", m: str = "m", shared: dict[str, Column] | None = None) -> Column:
    """The score of a pair of rows; ``shared`` are the counts of ``_shared`` if they are there already."""
    shared, col, size = shared or _shared(c, m), (lambda p, x: F.col(f"{p}_{x}")), (lambda p, x: F.size(f"{p}_{x}"))
    either = lambda x: (size(c, x) == 0) | (size(m, x) == 0)
    jaccard = lambda x: shared[f"_{x}"] / (size(c, x) + size(m, x) - shared[f"_{x}"])
    same_host = F.when(either("path"), F.lit(0.3)).otherwise(jaccard("path"))
    u = F.when((col(c, "url") == "") | (col(m, "url") == "") | (col(c, "host") != col(m, "host")), F.lit(0.0)).when(col(c, "url") == col(m, "url"), F.lit(1.0)).otherwise(same_host)
    titles = F.when(either("title"), F.lit(0.0)).otherwise(jaccard("title"))
    ents = F.when(either("ent"), F.lit(0.0)).otherwise(shared["_ent"] / F.least(size(c, "ent"), size(m, "ent")))
    score = URL_WEIGHT * u + TITLE_WEIGHT * titles + ENTITY_WEIGHT * ents
    return F.round(F.when(u == 1.0, F.greatest(score, F.lit(SAME_URL))).otherwise(score), 4)


def _coded(df: DataFrame, p: str) -> DataFrame:
    """Words as 64-bit hashes, which compare faster than texts."""
    return df.withColumns({f"{p}_{c}": F.transform(f"{p}_{c}", lambda t: F.xxhash64(t)) for c in ("title", "ent", "path")})


def best_matches(candidates: DataFrame, memory: DataFrame, least: float = 0.3, block: int = 512) -> DataFrame:
    """(candidate_id, memory_id, score, band) of every candidate: its best match in the memory of ``least`` or more, else nulls and 'distinct'.

    Both have id, url, title, entities. A top-1 similarity join: rows of one host meet by a path word, as
    those can be matches whatever their titles are; all others need titles with a certain Jaccard index,
    so both sides are found by their titles' rarest words (a prefix filter), and no match is lost; of rows
    of the memory with one title and the same entities the first is found by it. A key's
    rows of the memory are dealt into blocks of about ``block`` and meet the candidates block by block;
    of the pairs only the smallest memory id for each candidate and score is kept. Ties go to the smaller
    memory id.

    Pairs on one host grow with the square of its pages that share a path word.
    """
    c, m = _shape(candidates, "c"), _shape(memory, "m")
    share = (least - 1e-4 - ENTITY_WEIGHT) / TITLE_WEIGHT
    often = m.select(F.explode("m_title").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    titled = {"c": c, "m": m.groupBy("m_title", "m_ent").agg(F.min("m_id").alias("m_id"))}
    keys = {p: df.select(f"{p}_id", F.explode(_keys(p, least)).alias("k")).unionByName(_title_keys(titled[p], p, often, share)) for p, df in (("c", c), ("m", m))}
    blocks = keys["m"].groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = keys["c"].join(blocks, "k").select("c_id", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = keys["m"].join(blocks, "k").select("m_id", "k", F.pmod(F.xxhash64("m_id"), F.col("blocks")).cast("int").alias("block"))
    # A small table makes many pairs: a fixed number of tasks, so that they are not dealt by the table's size.
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = asked.join(_coded(c, "c"), "c_id").repartition(parts, "k", "block").join(held.join(_coded(m, "m"), "m_id").repartition(parts, "k", "block"), ["k", "block"])
    counted = pairs.withColumns(_shared())  # each once
    first = counted.groupBy("c_id", match_score(shared={x: F.col(x) for x in _shared()}).alias("score")).agg(F.min("m_id").alias("m_id"))
    best = first.groupBy("c_id").agg(F.max_by("m_id", "score").alias("memory_id"), F.max("score").alias("score")).where(F.col("score") >= least)
    out = candidates.select(F.col("id").alias("c_id")).distinct().join(best, "c_id", "left")
    return out.select(F.col("c_id").alias("candidate_id"), "memory_id", "score", F.coalesce(duplicate_band(F.col("score")), F.lit("distinct")).alias("band"))


def match_stats(matches: DataFrame) -> DataFrame:
    """One row: candidates checked, how many of each band, the mean score of those with a match."""
    n = lambda band: F.count(F.when(F.col("band") == band, 1)).alias(band)
    return matches.agg(F.count(F.lit(1)).alias("checked"), *map(n, ("duplicate", "likely_duplicate", "related", "distinct")), F.round(F.avg("score"), 4).alias("mean_score"))


def matching_packs(stories: DataFrame, packs: DataFrame, limit: int = 2) -> DataFrame:
    """(story_no, pack_no, by): for each story the first ``limit`` packs that share a URL (by 'url'), else the pack at its place ('position').

    Both have a place (story_no, pack_no, from 0) and urls. Only the first ``limit`` packs of a URL can
    be among a story's first, so pairs are at most that many for each URL of a story, however many
    packs share it. URLs other than http(s) don't count; a story without a match and without a pack at
    its place has no row.
    """
    web = lambda df, no: df.select(no, F.explode(F.array_distinct(F.transform("urls", fn.clean))).alias("url")).where("url rlike '^https?://'")
    ranked = web(packs, "pack_no").withColumn("_n", F.row_number().over(W.partitionBy("url").orderBy("pack_no"))).where(F.col("_n") <= limit).drop("_n")
    met = web(stories, "story_no").join(ranked, "url").select("story_no", "pack_no").distinct()
    first = met.withColumn("_n", F.row_number().over(W.partitionBy("story_no").orderBy("pack_no"))).where(F.col("_n") <= limit)
    found = first.select("story_no", "pack_no", F.lit("url").alias("by"))
    rest = stories.select("story_no").join(found.select("story_no").distinct(), "story_no", "left_anti")
    placed = rest.join(packs.select("pack_no"), rest["story_no"] == packs["pack_no"]).select("story_no", "pack_no", F.lit("position").alias("by"))
    return found.unionByName(placed)


def replacements(stories: DataFrame, pool: DataFrame, limit: int = 8, salts: int = 32) -> DataFrame:
    """(story_id, rank, candidate_no): for each story the ``limit`` hottest candidates of its theme or of none.

    Stories have story_id and theme_section, of a short list of sections; the pool has candidate_no (its
    order), key, theme_section and heat_score. A story without a theme takes any candidate. Of rows with
    one key (empty keys are all different) the first of those that fit counts. Ties go to the first in order.

    Candidates are cut to ``limit`` for each theme and salt before they meet for the theme, so no task
    holds a whole theme, and stories meet lists of ``limit`` rows.
    """
    theme = fn.clean(F.col("theme_section"))
    wanted = stories.select(theme.alias("want")).distinct()
    rows = pool.select("candidate_no", F.coalesce(F.nullif(F.concat(F.lit("k:"), F.col("key")), F.lit("k:")), F.concat(F.lit("n:"), F.col("candidate_no").cast("string"))).alias("key"), theme.alias("theme"), F.coalesce("heat_score", F.lit(0.0)).cast("double").alias("heat"))
    # The first row of each key and theme; those without a theme, and for stories without one all, go to each theme asked for.
    first = rows.groupBy("theme", "key").agg(F.min_by(F.struct("candidate_no", "heat"), "candidate_no").alias("c"))
    own = first.where("theme <> ''").join(F.broadcast(wanted), F.col("theme") == F.col("want")).select("want", "key", "c")
    shared = first.where("theme = ''").join(F.broadcast(wanted.where("want <> ''"))).select("want", "key", "c")
    whole = first.join(F.broadcast(wanted.where("want = ''"))).select("want", "key", "c")  # one row at most
    fit = own.unionByName(shared).unionByName(whole).groupBy("want", "key").agg(F.min("c").alias("c")).select("want", "c.*")
    order = [F.desc("heat"), F.col("candidate_no")]
    part = fit.withColumn("salt", F.pmod(F.xxhash64("candidate_no"), F.lit(salts)))
    part = part.withColumn("_n", F.row_number().over(W.partitionBy("want", "salt").orderBy(*order))).where(F.col("_n") <= limit)
    best = part.withColumn("rank", F.row_number().over(W.partitionBy("want").orderBy(*order))).where(F.col("rank") <= limit).select("want", "rank", "candidate_no")
    return stories.select("story_id", theme.alias("want")).join(best, "want").select("story_id", "rank", "candidate_no")


# Sources and domains in Chinese.
CHINESE_SOURCES = ["gamergen", "gamersky", "bilibili", "weibo", "xiaoheihe", "tieba", "taptap", "3dm", "ali213"]
CHINESE_DOMAINS = ["gamersky.com", "bilibili.com", "weibo.com", "3dmgame.com", "ali213.net"]


def is_chinese(source_id: Column, url: Column, sources: list[str] = CHINESE_SOURCES) -> Column:
    return F.lower(fn.clean(source_id)).isin(sources) | fn.any_contained(CHINESE_DOMAINS, F.lower(F.coalesce(url, F.lit(""))))


def localization_requests(stories: DataFrame, pool: DataFrame, selected: DataFrame | None = None, ordinal: str = "ordinal", limit: int | None = None, replacements_each: int = 8, quotes: int = 3) -> DataFrame:
    """(request_id, story_id, title, theme_section, selected_final_story, evidence_quotes, candidate_replacements): what is asked for each story in English, the first ``limit`` of them.

    Stories have id, title, theme_section, source_language, source_preference and evidence (an array of
    source_id, title, quote, in order); the pool is of ``replacements`` with title, url and source_id, and only
    its candidates in Chinese count. A story is English by its language, or by a fallback to an English or
    original source unless it is in Chinese. Its id is its title where it has none; without both it is left out.
    """
    language, taken = F.lower(fn.clean(F.col("source_language"))), F.lower(fn.clean(F.col("source_preference")))
    english = (language == "en") | (taken.isin("english_ign_fallback", "original_source_used") & (language != "zh"))
    story_id = F.coalesce(F.nullif(fn.clean(F.col("id").cast("string")), F.lit("")), fn.clean(F.col("title")))
    rows = stories.where(english).withColumn("story_id", story_id).where("story_id <> ''")
    if limit is not None:
        rows = rows.orderBy(ordinal).limit(max(limit, 0))
    chinese = pool.where(is_chinese(F.col("source_id"), F.col("url")))
    found = replacements(rows.select("story_id", "theme_section").distinct(), chinese, replacements_each)
    item = F.struct("rank", F.struct("title", "url", "source_id", "theme_section", "heat_score").alias("c"))
    named = found.join(chinese.select("candidate_no", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "source_id", "theme_section")), F.coalesce("heat_score", F.lit(0.0)).alias("heat_score")), "candidate_no")
    listed = named.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("candidate_replacements"))
    out = rows.join(listed, "story_id", "left")
    if selected is not None:
        out = out.join(selected.select(F.col("id").cast("string").alias("story_id"), F.lit(True).alias("_selected")).distinct(), "story_id", "left")
    said = F.filter(F.coalesce("evidence", F.expr("cast(array() AS array<struct<source_id:string,title:string,quote:string>>)")), lambda e: fn.clean(e["quote"]) != "")
    shown = F.transform(F.slice(said, 1, quotes), lambda e: F.struct(F.coalesce(e["source_id"], F.lit("")).alias("source_id"), F.coalesce(e["title"], F.lit("")).alias("title"), F.substring(F.trim(e["quote"]), 1, 700).alias("quote")))
    none = F.array().cast(listed.schema["candidate_replacements"].dataType)
    chosen = F.coalesce("_selected", F.lit(False)) if selected is not None else F.lit(False)
    return out.select(F.concat(F.lit("story_localization:"), "story_id").alias("request_id"), "story_id", F.coalesce("title", F.lit("")).alias("title"), fn.clean(F.col("theme_section")).alias("theme_section"), chosen.alias("selected_final_story"), shown.alias("evidence_quotes"), F.coalesce("candidate_replacements", none).alias("candidate_replacements"))
