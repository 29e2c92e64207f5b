import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm.quantiles import PERCENTILES, RELATIVE_ERROR, K, Sketch, build_sketches, merge_sketches, percentiles


def errors(values, sketch, high=True):
    values = np.sort(values)
    out = []
    for p, v in zip(PERCENTILES, sketch.quantiles(PERCENTILES), strict=True):
        lo, hi = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
        out.append(max(0.0, lo - p, p - hi) / ((1 - p) if high else p))
    return max(out)


@pytest.mark.parametrize("tail", ["high", "low"])
@pytest.mark.parametrize("kind", ["lognormal", "sorted", "few", "constant"])
def test_error(tail, kind):
    rng = np.random.default_rng(4)
    x = {"lognormal": rng.lognormal(size=300_000), "sorted": np.arange(300_000.0), "few": rng.integers(0, 60, 300_000) * 1.0, "constant": np.full(300_000, 7.0)}[kind]
    parts = [Sketch(tail=tail) for _ in range(7)]
    for i, chunk in enumerate(np.array_split(x, 500)):
        parts[i % 7].update(chunk)
    whole = Sketch(tail=tail)
    for p in parts:
        whole.merge(Sketch.from_bytes(p.to_bytes()))
    assert whole.n == len(x) == sum(lv.held << h for h, lv in enumerate(whole.levels))
    assert errors(x, whole, tail == "high") <= 4 * RELATIVE_ERROR / K
    assert (whole.low, whole.top) == (x.min(), x.max()) and len(whole.to_bytes()) < 200_000
    assert whole.quantiles((0.0, 1.0)) == [x.min(), x.max()]


def test_small_is_exact():
    s = Sketch()
    s.update(np.array([3.0, 1.0, 2.0, 2.0]))
    s.update(np.zeros(0))
    assert s.quantiles((0.25, 0.5, 0.75, 0.99)) == [1.0, 2.0, 2.0, 3.0]


def test_days_and_groups(spark):
    df = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE concat('c', id % 3) END AS contig", "CAST(id % 5 AS INT) AS day", "CASE WHEN id % 10 = 9 THEN NULL ELSE CAST(id AS DOUBLE) END AS v", "1 AS sketch")
    days = build_sketches(df, {"contig": F.col("contig"), "day": F.col("day")}, F.col("v"))
    assert days.count() == 15
    merged = {r.contig: r for r in percentiles(merge_sketches(days, ["contig"]), (0.5,)).collect()}
    direct = {r.contig: r for r in percentiles(build_sketches(df, {"contig": F.col("contig")}, F.col("v")), (0.5,)).collect()}
    assert merged.keys() == direct.keys() == {None, "c1", "c2"}
    for k in merged:
        assert merged[k].n == direct[k].n == 18_000 and abs(merged[k].value - 30_000) < 600 and abs(direct[k].value - 30_000) < 600


def test_empty_and_odd(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert percentiles(build_sketches(empty, {"g": F.col("g")}, F.col("v"))).count() == 0
    odd = spark.createDataFrame([("a", float("nan")), ("a", None), ("a", 1.0), ("b", None)], "g string, v double")
    assert [(r.g, r.value, r.n) for r in percentiles(build_sketches(odd, {"g": F.col("g")}, F.col("v")), (0.5,)).collect()] == [("a", 1.0, 1)]
