import random
from collections import Counter

from pyspark.sql import functions as F

from spanlake.operators.coverage import coverage, per_base, target_depth, windows
from spanlake.operators.pileup import pileup
from spanlake.streaming.depth import blocks_of, change_counts
from tests.conftest import rows

READS = "contig string, pos_start int, pos_end int, cigar string, flag int, mapq int"


def test_blocks(spark):
    reads = [("chr1", 1, 4, "4M", 0, 60), ("1", 3, 5, "3M", 16, 60), ("1", 3, 8, "6M", 0, 9), ("1", 20, 22, "3M", 0, 60), ("chrM", 2, 3, "2M", 0, 60), ("1", 1, 9, "9M", 4, 60), ("1", 7, 7, "1M", 0, 60), (None, 1, 2, "2M", 0, 60), ("1", 5, 3, "2M", 0, 60), ("1", 1, 9, "9M", None, 60)]
    df = spark.createDataFrame(reads, READS)
    want = [("1", 1, 2, "R", 1), ("1", 3, 4, "R", 3), ("1", 5, 5, "R", 2), ("1", 6, 8, "R", 1), ("1", 20, 22, "R", 1), ("MT", 2, 3, "R", 1)]
    assert rows(coverage(df)) == want
    assert rows(coverage(df, min_mapq=10)) == [("1", 1, 2, "R", 1), ("1", 3, 4, "R", 2), ("1", 5, 5, "R", 1), ("1", 20, 22, "R", 1), ("MT", 2, 3, "R", 1)]
    lengths = spark.createDataFrame([("1", 30), ("2", 5)], "contig string, n_bases int")
    zero = [r for r in rows(coverage(df, contigs=lengths)) if r[4] == 0]
    assert zero == [("1", 9, 19, "R", 0), ("1", 23, 30, "R", 0), ("2", 1, 5, "R", 0)]
    assert coverage(df.limit(0)).count() == 0
    assert rows(windows(coverage(df), 10)) == [("1", 1, 10, 1.3), ("1", 21, 30, 0.2), ("1", 11, 20, 0.1), ("MT", 1, 10, 0.2)] or rows(windows(coverage(df), 10)) == [("1", 1, 10, 1.3), ("1", 11, 20, 0.1), ("1", 21, 30, 0.2), ("MT", 1, 10, 0.2)]
    t = spark.createDataFrame([("1", 4, 21, "a")], "contig string, pos_start int, pos_end int, name string")
    assert rows(target_depth(coverage(df), t)) == [("1", "a", 4, 21, 7, 1, 10 / 7, 3)]


def test_targets_stand_in_few_bins(spark, tmp_path):
    """Long blocks give what their positions give; a small file of targets isn't broadcast with a row for every level."""
    rng = random.Random(3)
    cuts = sorted(rng.sample(range(-3000, 9000), 40)) + [2**31 - 5000, 2**31 - 1]
    blocks = [("1", a, b - (b < 2**31 - 1), rng.randint(1, 9)) for a, b in zip(cuts, cuts[1:], strict=False) if b - a < 9000]
    spans = [(s := rng.randint(-4000, 9000), s + rng.choice([0, 5, 70, 1023, 1024, 4000])) for _ in range(80)] + [(2**31 - 3000, 2**31 - 1), (-3000, 2**31 - 1)]
    b = spark.createDataFrame([*blocks, ("1", 5000, 100, 3), (None, 1, 9, 3), ("1", None, 9, 3)], "contig string, pos_start int, pos_end int, coverage int")
    spark.createDataFrame([("1", s, e, str(i)) for i, (s, e) in enumerate(spans)], "contig string, pos_start int, pos_end int, name string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    want = []
    for i, (s, e) in enumerate(spans):
        if own := [(min(e, y) - max(s, x) + 1, d) for _, x, y, d in blocks if x <= e and y >= s]:
            n = sum(k for k, _ in own)
            want.append(("1", str(i), s, e, n, min(d for _, d in own), sum(k * d for k, d in own) / n, max(d for _, d in own)))
    assert rows(target_depth(b, t)) == sorted(want)
    plan = target_depth(b, t)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tiles(spark):
    rng = random.Random(2)
    spans = [(s := rng.randint(1, 400_000), s + rng.choice([1, 3, 90, 80_000])) for _ in range(300)] + [(65_536, 65_540), (131_070, 131_072)]
    df = spark.createDataFrame([("1", s, e) for s, e in spans], "contig string, pos_start int, pos_end int")
    depth = Counter(p for s, e in spans for p in range(s, e + 1))
    blocks = rows(coverage(df))
    assert {p: c for _, s, e, _, c in blocks for p in range(s, e + 1)} == depth
    assert all(a[4] != b[4] or a[2] + 1 != b[1] for a, b in zip(blocks, blocks[1:], strict=False))
    assert per_base(coverage(df)).count() == len(depth)


def test_stream_of_reads(spark, tmp_path):
    schema = "contig string, pos_start int, pos_end int"
    spark.createDataFrame([("1", 1, 4), ("1", 3, 5), ("2", 9, 10)], schema).write.parquet(str(tmp_path / "in"))
    held = str(tmp_path / "held")
    q = change_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(held)).start()
    q.processAllAvailable()
    q.stop()
    assert rows(blocks_of(spark.read.parquet(held))) == [("1", 1, 2, 1), ("1", 3, 4, 2), ("1", 5, 5, 1), ("2", 9, 10, 1)]


def test_pileup(spark):
    reference = spark.createDataFrame([("1", 1, "AACCGGTTAA"), ("1", 11, "CCGGTTAACC")], "contig string, chunk_start int, bases string")
    # reads against it: position 5 (G) read as T forward and a on the reverse strand, a deletion of 8 to 9
    reads = [
        ("chr1", 3, 7, "5M", "CCTGT", "IIIII", 0, "2G2"), ("1", 4, 8, "5M", "CAGTT", "5678]", 16, "1G3"), ("1", 5, 12, "3M2D3M", "GGTACC", "ABCDEF", 0, "3^TA3"), ("1", 2, 6, "1S5M", "NACCGG", "!IIII?", 16, "5"), ("1", 2, 6, "5M", "ACCGG", "IIIII", 0, None),
    ]
    df = spark.createDataFrame(reads, "contig string, pos_start int, pos_end int, cigar string, seq string, qual string, flag int, tag_md string")
    got = {r.pos_start: r for r in pileup(df, reference, quals=True).collect()}
    assert {(s, r.pos_end, r.ref, r.coverage) for s, r in got.items()} == {(2, 2, "A", 2), (3, 3, "C", 3), (4, 4, "C", 4), (5, 5, "G", 5), (6, 6, "G", 5), (7, 7, "T", 3), (8, 8, "T", 1), (10, 12, "ACC", 1)}
    at = got[5]
    assert (at.alts, at.countRef, at.countNonRef) == ({"T": 1, "a": 1}, 3, 2)
    held = {b: {i: n for i, n in enumerate(a) if n} for b, a in at.quals.items()}
    assert held == {"T": {40: 1}, "a": {21: 1}, "G": {32: 1, 40: 2}} and sum(sum(a) for a in at.quals.values()) == at.coverage
    assert all(r.alts is None and r.quals is None and r.countNonRef == 0 for s, r in got.items() if s != 5)
    binned = {r.pos_start: r for r in pileup(df, None, quals=True, bin_size=10).collect()}
    assert [i for i, n in enumerate(binned[5].quals["G"]) if n] == [3, 4] and binned[5].ref == "G" and binned[2].ref == "R"
    assert pileup(df.limit(0), reference, quals=True).count() == 0
    assert pileup(df, reference).where(F.col("quals").isNotNull()).count() == 0
