"""The bitmap of wanted keys loses none of them, whatever slot they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.llm.common import may_hold


def test_no_wanted_key_is_lost(spark):
    """All slots are taken in a small bitmap, few in a large one; null keys are in no bitmap's way."""
    rows = spark.range(200_000).select(F.xxhash64("id").alias("b"), "id")
    some = rows.where("id % 50 = 0").select("b")
    for bits in (15, 16, 26):
        found = may_hold(rows, "b", some, bits)
        assert found.columns == ["b", "id"]
        assert found.where("id % 50 = 0").count() == 4000
    assert may_hold(rows, "b", some).count() < 5000
    assert may_hold(rows, "b", rows.select("b"), 15).count() == 200_000
    nulls = spark.range(5).select(F.when(F.col("id") > 1, F.col("id")).alias("b"))
    assert {2, 3, 4} <= {r.b for r in may_hold(nulls, "b", nulls).collect()}
    assert may_hold(rows, "b", some.limit(0)).count() == 0
