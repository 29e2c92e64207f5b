import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.functions import ranges
from spanlake.operators.intervals import _Bins, feature_counts, interval_join, overlap_counts
from tests.conftest import rows

# A small join and its result.
S1 = [(100, 190), (200, 290), (400, 600), (10000, 20000), (22100, 22100)]
S2 = [(150, 250), (190, 300), (300, 500), (500, 700), (22000, 22300), (15000, 15000)]
PAIRS = [(100, 190, 150, 250), (100, 190, 190, 300), (200, 290, 150, 250), (200, 290, 190, 300), (400, 600, 300, 500), (400, 600, 500, 700), (10000, 20000, 15000, 15000), (22100, 22100, 22000, 22300)]


def test_small_join(spark):
    a, b = spark.createDataFrame(S1, "s int, e int"), spark.createDataFrame(S2, "s int, e int")
    for plan in ("binned", "hash"):
        assert rows(interval_join(a, b, [], left_span=("s", "e"), right_span=("s", "e"), plan=plan)) == PAIRS


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
@pytest.mark.parametrize(("overlap", "gap"), [(1, 0), (5, 0), (1, 30)])
def test_both_plans_as_brute_force(spark, how, overlap, gap):
    rng = random.Random(overlap + gap)

    def some(n):
        return [(rng.choice(["1", "2", None]), s := rng.choice([None, rng.randint(-50, 2000)]), None if s is None else s + rng.choice([-3, 0, 4, 90]), i) for i in range(n)] * 2

    left, right = some(60), some(50)

    def hit(x, y):
        if None in (*x[:3], *y[:3]) or x[0] != y[0] or x[2] < x[1] or y[2] < y[1]:
            return False
        return x[2] + gap >= y[1] and x[1] - gap <= y[2] and (overlap == 1 or min(x[2], y[2]) - max(x[1], y[1]) + 1 >= overlap)

    want = []
    for x in left:
        own = [y for y in right if hit(x, y)]
        want += {"right": [x + y for y in own], "full": [x + y for y in own] or [x + (None,) * 4], "inner": [x + y for y in own], "left": [x + y for y in own] or [x + (None,) * 4], "left_semi": [x] * bool(own), "left_anti": [x] * (not own)}[how]
    if how in ("right", "full"):
        want += [(None,) * 4 + y for y in right if not any(hit(x, y) for x in left)]
    key = lambda t: tuple((v is not None, v) for v in t)
    a, b = (spark.createDataFrame(r, "contig string, pos_start int, pos_end int, n int") for r in (left, right))
    for plan in ("binned", "hash"):
        assert rows(interval_join(a, b, how=how, min_overlap=overlap, max_gap=gap, plan=plan, bin_size=64)) == sorted(want, key=key)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_hash_takes_bins_where_groups_are_large(spark, how):
    """Else each row would be tested with all rows of its key."""
    rng = random.Random(8)

    def some(n, far):
        own = [(rng.choice(["1", "1", None]), s := rng.choice([None, rng.randint(-far, far)]), None if s is None else s + rng.choice([-3, 0, 90, far]), i) for i in range(n)]
        return [*own, ("1", 0, 5, n), ("2", -far, far, n)]

    for far, kind in ((3000, "int"), (2**50, "long")):
        a, b = (spark.createDataFrame(some(n, far), f"contig string, pos_start {kind}, pos_end {kind}, n int") for n in (300, 400))
        b2 = b.toDF("c", "s", "e", "m")
        overlap = (a.pos_end >= b2.s) & (a.pos_start <= b2.e) & (a.pos_start <= a.pos_end) & (b2.s <= b2.e)
        for keys, met in [(["contig"], overlap & (a.contig == b2.c)), ([], overlap)][: 1 + (how == "inner")]:
            df = interval_join(a, b, keys, how, plan="hash")
            assert rows(df) == rows(a.join(b2, met, how))
            assert "_place1" in df._jdf.queryExecution().analyzed().toString()
        few = interval_join(a, b.limit(60), how=how, plan="hash")
        assert "_place1" not in few._jdf.queryExecution().analyzed().toString()


def test_hash_shuffles_many_rows_in_bins(spark, tmp_path):
    df = spark.range(120_000).selectExpr("'1' AS contig", "CAST(id AS INT) AS pos_start", "CAST(id + 1 AS INT) AS pos_end")
    df.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert "Broadcast" not in interval_join(t, t, plan="hash")._jdf.queryExecution().executedPlan().toString()
    assert interval_join(t, t, plan="hash").count() == 3 * 120_000 - 2


def test_empty_and_counts(spark):
    a = spark.createDataFrame([("1", 1, 10), ("1", 5, 6)], "contig string, pos_start int, pos_end int")
    assert interval_join(a, a.limit(0)).count() == 0
    assert interval_join(a, a.limit(0), how="left").count() == 2
    assert rows(feature_counts(a, a), "pos_start", "pos_end", "n_reads", "length") == [(1, 10, 2, 10), (5, 6, 2, 2)]
    assert rows(overlap_counts(a.limit(0), a), "n") == [(0,), (0,)] and overlap_counts(a, a.limit(0)).count() == 0


def test_levels(spark):
    """The longest interval is some tens of rows, and meets the shortest."""
    rng = random.Random(4)
    a = [("1", 1, 250_000_000), ("1", 40_000_000, 200_000_000), *(("1", s := rng.randint(1, 250_000_000), s + rng.choice([0, 80, 70_000])) for _ in range(200))]
    b = [("1", s := rng.randint(1, 250_000_000), s + rng.choice([0, 30, 5_000_000, 100_000_000])) for _ in range(100)]
    da, db = (spark.createDataFrame(x, "contig string, pos_start int, pos_end int") for x in (a, b))
    want = sorted(x + y for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    for measured in (("left", "right"), ("right",), ()):
        assert rows(interval_join(da, db, measured=measured)) == want
    points = db.withColumn("pos_end", F.col("pos_start"))
    assert rows(interval_join(da, points, right_longest=1)) == rows(interval_join(da, points, plan="hash"))
    bins = _Bins(64)
    s, e = F.col("pos_start"), F.col("pos_end")
    assert bins.repeated(da.where("pos_start = 1"), s, e, bins.levels(None, s, e), "l", "b").count() <= 60
    got = {(r.pos_start, r.pos_end): r.n for r in overlap_counts(da, db, 100).collect()}
    assert got == {(s, e): sum(x[1] <= e + 100 and s - 100 <= x[2] for x in a) for _, s, e in b}


# What the interval functions give for (11873, 14409).
GOLDEN = [
    (lambda: ranges.shift("s", "e", 5), "shift(s, e, 5)", (11878, 14414)),
    (lambda: ranges.resize("s", "e", 5, "center"), "resize(s, e, 5, 'center')", (11870, 14411)),
    (lambda: ranges.resize("s", "e", 5, "START"), "resize(s, e, 5, 'start')", (11873, 14414)),
    (lambda: ranges.resize("s", "e", 5, "end"), "resize(s, e, 5, 'End')", (11868, 14409)),
    (lambda: ranges.flank("s", "e", 5, True, False), "flank(s, e, 5, true, false)", (11868, 11872)),
    (lambda: ranges.flank("s", "e", 5, False, False), "flank(s, e, 5, false, false)", (14410, 14414)),
    (lambda: ranges.flank("s", "e", 5, True, True), "flank(s, e, 5, true, true)", (11868, 11877)),
    (lambda: ranges.flank("s", "e", 5, False, True), "flank(s, e, 5, false, true)", (14405, 14414)),
    (lambda: ranges.flank("s", "e", -5, True, False), "flank(s, e, -5, true, false)", (11873, 11877)),
    (lambda: ranges.flank("s", "e", -5, False, False), "flank(s, e, -5, false, false)", (14405, 14409)),
    (lambda: ranges.flank("s", "e", -5, False, True), "flank(s, e, -5, false, true)", (14405, 14414)),
    (lambda: ranges.promoters("s", "e", 100, 20), "promoters(s, e, 100, 20)", (11773, 11892)),
    (lambda: ranges.reflect("s", "e", 11000, 15000), "reflect(s, e, 11000, 15000)", (11591, 14127)),
]


def test_functions(spark):
    ranges.register(spark, ("", "my_"))
    df = spark.createDataFrame([(11873, 14409)], "s int, e int")
    for column, sql, want in GOLDEN:
        assert tuple(df.select(column().alias("x")).first().x) == want
        if not sql.startswith("reflect"):
            assert tuple(df.selectExpr(f"{sql} AS x").first().x) == want
        assert tuple(df.selectExpr(f"my_{sql} AS x").first().x) == want
    assert df.selectExpr("overlaplength(s, e, 14000, 15000) AS n", "overlap(1, 2, 5, 6) AS m").first() == (410, -2)
    assert df.select(ranges.overlap_length("s", "e", 14000, 15000)).first()[0] == 410
    with pytest.raises(Exception, match="negative"):
        df.select(ranges.promoters("s", "e", -1, 2)).collect()
    assert spark.sql("SELECT * FROM my_grange('1', 5, 9)").first() == ("1", 5, 9)
    assert len(spark.sql("SELECT reflect('java.util.UUID', 'randomUUID')").first()[0]) == 36


def test_join_order_broadcasts_the_right_side(spark, tmp_path):
    from spanlake.plans.intervals import QUERIES

    spark.sql("SELECT 1 AS l_suppkey, 7 AS l_partkey, 5 AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus, 1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 6 AS p_partkey, 9 AS p_size, 'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: QUERIES[n](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString() for n in ("iv_join_order", "iv_overlap_join")}
        assert "BroadcastHashJoin" in plans["iv_join_order"] and "BuildRight" in plans["iv_join_order"]
        assert "Broadcast" not in plans["iv_overlap_join"]
        assert rows(QUERIES["iv_join_order"](spark, str(tmp_path))) == rows(QUERIES["iv_overlap_join"](spark, str(tmp_path))) == [("1", 6, 14, "b", 1, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_joins_in_sql(spark):
    """Overlap joins in plain SQL, in every spelling, against Spark's own plan; none is a nested loop."""
    from spanlake.session import Session

    rng = random.Random(6)
    for name in ("sj_a", "sj_b"):
        own = [(rng.choice(["1", "2", None]), s := rng.choice([None, rng.randint(-50, 3000)]), None if s is None else s + rng.choice([-30, 0, 4, 90, 2000]), i) for i in range(150)]
        spark.createDataFrame(own, "c string, s int, e long, i int").createOrReplaceTempView(name)
    conditions = [
        "a.e >= b.s AND a.s <= b.e", "b.s <= a.e AND b.e >= a.s AND a.c = b.c", "a.e > b.s AND a.s < b.e AND a.i <> b.i", "a.s >= b.s AND a.e <= b.e", "CAST(a.e AS INT) >= b.s AND b.c = a.c AND CAST(a.s AS BIGINT) <= b.e AND a.i % 2 = b.i % 3",
    ]
    ours = Session(spark)
    for c in conditions:
        q = f"SELECT a.c, a.s, a.e, a.i, b.*, 'FROM coverage(x, y, z)' AS said FROM sj_a a JOIN sj_b b ON {c} -- FROM pileup(a)"
        df = ours.sql(q)
        assert Counter(map(tuple, df.collect())) == Counter(map(tuple, spark.sql(q).collect())), c
        assert "NestedLoop" not in (p := df._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in p and "_bin1" in p
    q = "SELECT count(*) AS n FROM sj_a a, sj_b b, sj_b d WHERE a.c = b.c AND a.e >= b.s AND a.s <= b.e AND d.e >= a.s AND d.s <= a.e"
    assert ours.sql(q).first() == spark.sql(q).first()
    for setting, value, c in (("maxGap", "100", "a.c = b.c AND a.e + 100 >= b.s AND a.s - 100 <= b.e"), ("minOverlap", "10", "a.c = b.c AND a.e >= b.s AND a.s <= b.e AND least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 10")):
        spark.conf.set(f"spanlake.{setting}", value)
        try:
            got = ours.sql("SELECT a.i, b.i AS j FROM sj_a a JOIN sj_b b ON a.c = b.c AND a.e >= b.s AND a.s <= b.e")
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, spark.sql(f"SELECT a.i, b.i AS j FROM sj_a a JOIN sj_b b ON {c}").collect()))
        finally:
            spark.conf.unset(f"spanlake.{setting}")
    ends = "(SELECT 5L AS s, 9000000000000000000L AS e UNION ALL SELECT -9000000000000000000L, 7L UNION ALL SELECT 20L, 21L)"
    q = f"SELECT a.s, b.s AS t FROM {ends} a JOIN {ends} b ON a.e >= b.s AND a.s <= b.e"
    assert rows(ours.sql(q)) == rows(spark.sql(q))
    assert ours.sql("SELECT 'taken FROM coverage(reads, S, ref)' AS x").first().x == "taken FROM coverage(reads, S, ref)"
    with pytest.raises(ValueError, match="arguments"):
        ours.sql("SELECT * FROM coverage('a', 'b')")
