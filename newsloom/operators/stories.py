"""Stories from verified claims: grouping, score, primary claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import functions as fn

# Publishable statuses, status bonuses and editorial fit words.
PUBLISHABLE = ["verified", "likely", "credible_rumor", "weak_rumor", "rumor"]
STATUS_BONUS = {"verified": 20.0, "likely": 12.0, "credible_rumor": 7.0, "weak_rumor": 1.0, "rumor": 2.0}
PREFERRED = [
    ["爆笑", "离谱", "无厘头", "梗", "整活", "逆天"], ["玩家", "客服", "补偿", "聊天", "截图", "操作"], ["涨价", "价格", "售价", "硬件", "手柄", "主机", "switch", "xbox", "ps5", "pc"], ["新功能", "上线", "更新", "新增", "在线数据", "多主机"],
    ["权威", "官方", "确认", "定档", "爆料"], ["争议", "dei", "亏损", "索尼", "微软", "任天堂"], ["m站", "metacritic", "opencritic", "媒体评分", "评分", "高分", "低分", "斩获"],
]
LOW_FIT = ["采访", "玩法细节", "机制", "新消息", "抉择机制", "情感玩法", "实机演示"]


def editorial_fit(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((F.when(fn.any_contained(words, low), 4.0).otherwise(0.0) for words in PREFERRED), F.lit(0.0)) - F.when(fn.any_contained(LOW_FIT, low), 7.0).otherwise(0.0)
    return F.greatest(F.lit(-10.0), F.least(F.lit(20.0), score))


def discussion_score(score: Column, level: Column, proven: Column) -> Column:
    """The score that counts: all of it with proof or a level of discussed or trending, 8 at most if weak, else none; without a level as it is."""
    return F.when(level.isNull() | proven | level.isin("discussed", "trending"), score).when(level == "weak", F.least(score, F.lit(8.0))).otherwise(0.0)


def ranked_stories(claims: DataFrame) -> DataFrame:
    """One row per story_id of publishable claims: score, number of claims and urls, primary claim.

    Claims have story_id, ordinal, text, check_status, confidence, heat_score, discussion_score, url,
    is_preferred_language and may have discussion_level and has_discussion_evidence, which limit the
    discussion score. The primary claim is the first in the preferred language, else the first.
    """
    held = claims.where(F.col("check_status").isin(PUBLISHABLE))
    if "discussion_level" in claims.columns:
        proven = F.coalesce("has_discussion_evidence", F.lit(False)) if "has_discussion_evidence" in claims.columns else F.lit(False)
        held = held.withColumn("discussion_score", discussion_score(F.col("discussion_score"), F.col("discussion_level"), proven))
    grouped = held.groupBy("story_id").agg(
        F.max("heat_score").alias("heat"), F.max("discussion_score").alias("discussion"), F.max("confidence").alias("confidence"), F.max(fn.lookup(F.col("check_status"), STATUS_BONUS, 0.0)).alias("bonus"),
        F.count_distinct("url").alias("source_count"), F.max(editorial_fit(F.col("text"))).alias("fit"), F.count(F.lit(1)).alias("claim_count"), F.min_by("text", F.struct(~F.col("is_preferred_language"), F.col("ordinal"))).alias("title"),
    )
    score = F.col("heat") * 0.55 + F.col("discussion") * 0.25 + F.col("confidence") * 16.0 + F.col("bonus") + F.col("source_count") * 2.0 + F.col("fit")
    return grouped.withColumn("story_score", F.round(F.least(F.lit(100.0), score), 2)).select("story_id", "title", "claim_count", "source_count", "story_score")
