from pyspark.sql import functions as F

from spanlake.operators.eager import Measure, eager_join_aggregate, heavy_pairs, pair_stats
from tests.conftest import rows

LEFT = [("a", "1", 5), ("a", "1", 7), ("a", "2", None), ("b", "1", 1), (None, "1", 4), ("c", None, 2)] + [("h", "1", 3)] * 50
RIGHT = [("a", "1", 10), ("a", "1", 20), ("b", "1", None), (None, "1", 9), ("z", "1", 8)] + [("h", "1", 2)] * 30


def frames(spark, left=LEFT, right=RIGHT):
    return spark.createDataFrame(left, "k string, g string, v int"), spark.createDataFrame(right, "k string, g string, v int")


def test_as_the_join(spark):
    left, right = frames(spark)
    keys = {"k": F.col("k"), "g": F.col("g")}
    a = [Measure("n_v", "count", F.col("v")), Measure("sum_v", "sum", F.col("v")), Measure("min_v", "min", F.col("v"))]
    b = [Measure("n_w", "count", F.col("v")), Measure("sum_w", "sum", F.col("v")), Measure("max_w", "max", F.col("v"))]
    for how in ("inner", "left", "full"):
        joined = left.join(right.select("k", "g", F.col("v").alias("w")), ["k", "g"], how)
        for group in (["k", "g"], ["g"]):
            want = joined.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count("v"), F.sum("v"), F.min("v"), F.count("w"), F.sum("w"), F.max("w"))
            got = eager_join_aggregate(left, right, keys, keys, a, b, how, group).select(*group, "n_joined", "n_v", "sum_v", "min_v", "n_w", "sum_w", "max_w")
            assert rows(got) == rows(want)


def test_empty(spark):
    left, right = frames(spark, [], [])
    keys = {"k": F.col("k")}
    assert eager_join_aggregate(left, right, keys, keys, [], []).count() == 0
    full, _ = frames(spark)
    assert eager_join_aggregate(full, right, keys, keys, [], [Measure("s", "sum", F.col("v"))], "left").where("s IS NOT NULL OR n_right <> 0").count() == 0


def test_heavy(spark):
    reads = [("s1", "chr7", i, i + 9, 60) for i in range(30)] + [("s1", "7", i, i + 9, None) for i in range(30)] + [(f"t{i}", "1", 5, 9, 1) for i in range(930)] + [(None, "1", 1, 2, 3)] * 500 + [("s2", None, 1, 2, 3)] * 510
    a = spark.createDataFrame(reads, "sample_id string, contig string, pos_start int, pos_end int, mapq int")
    c = spark.createDataFrame([("s1", "7", 4)], "sample_id string, contig string, coverage int")
    assert rows(heavy_pairs(a, c)) == [("s1", "7", 60, 1, 60)]
    assert rows(heavy_pairs(a, c, 4)) == []
    plan = heavy_pairs(a, c)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    assert pair_stats(a, c).where("sample_id = 's1'").select("n_left", "n_joined", "sum_coverage").first() == (60, 60, 240)
    assert heavy_pairs(a.limit(0), c).count() == 0
