from pyspark.sql import functions as F

from spanlake.functions.alignment import aligned_blocks, indices_in_read, md_ops, mismatches, read_index
from spanlake.functions.contigs import chr_contig, plain_contig

CIGARS = [
    (7801998, "78M1D23M", {7801998: 0, 7802099: 100}),
    (220108224, "82M1D19M", {220108224: 0, 220108325: 100}),
    (813652, "20M4I4M4I33M1D6M1I29M", {813652: 0, 813671: 19, 813672: 24, 813673: 25, 813675: 27, 813676: 32, 813744: 100}),
    (76032260, "6S6M37D89M", {76032260: 6, 76032265: 11, 76032266: None}),
]


def test_places_in_the_read(spark):
    for start, cigar, spots in CIGARS:
        for pos, want in spots.items():
            assert read_index(start, cigar, pos) == want
            df = spark.createDataFrame([(start, cigar, pos)], "s int, c string, p int")
            assert df.select(indices_in_read(aligned_blocks("s", "c"), F.col("p"))).first()[0] == ([] if want is None else [want])


def test_blocks(spark):
    df = spark.createDataFrame([(10, "5M"), (10, "2S3M2N4=1I2X5H"), (10, "*"), (10, None), (10, "4I")], "s int, c string")
    got = [[tuple(b)[:3] for b in r[0]] for r in df.select(aligned_blocks("s", "c")).collect()]
    assert got == [[(10, 14, 0)], [(10, 12, 2), (15, 18, 5), (19, 20, 10)], [], [], []]


def test_md():
    assert md_ops("10A5^AC6") == [("=", 10, ""), ("X", 1, "A"), ("=", 5, ""), ("D", 2, "AC"), ("=", 6, "")]
    assert md_ops("0C0^G0T") == [("X", 1, "C"), ("D", 1, "G"), ("X", 1, "T")] and md_ops(None) == []
    assert mismatches(100, "2S4M2D4M", "1A2^CC0G3", "ttACGTTCGA".upper(), False) == [(101, "C", "A"), (106, "T", "G")]
    assert mismatches(100, "4M", "1A2", "ACGT", True) == [(101, "c", "A")]
    assert mismatches(100, "2M5N2M", "3A", "ACGT", False) == [(108, "T", "A")]
    assert mismatches(100, "4M", "1A", "", False) == [] and mismatches(100, "4M", "9A", "ACGT", False) == []


def test_contigs(spark):
    df = spark.createDataFrame([("chr1",), ("chrM",), ("M",), ("MT",), ("X",), ("CHR2",), (None,)], "c string")
    assert [r[0] for r in df.select(plain_contig("c")).collect()] == ["1", "MT", "MT", "MT", "X", "CHR2", None]
    assert [r[0] for r in df.select(chr_contig("c")).collect()] == ["chr1", "chrM", "chrM", "chrM", "chrX", "chrCHR2", None]


def test_mismatches_of_all_operations(spark):
    """The pass over the reads against the one by hand, with clips, insertions, deletions, skips and lower-case tags."""
    import random

    from spanlake.operators.pileup import mismatch_counts

    rng, reads = random.Random(8), []
    for _ in range(300):
        ops, md, seq, same = [], "", "", 0
        for op in rng.choice(["M", "SMIM", "MDM", "HSMNMS", "MIMDMNM", "=X="]):
            n = rng.randint(1, 9)
            ops.append(f"{n}{op}")
            seq += "".join(rng.choice("ACGTN") for _ in range(n if op in "MIS=X" else 0))
            for _ in range(n if op in "M=X" else 0):
                if rng.random() < 0.2:
                    md, same = md + f"{same}{rng.choice('ACgt')}", 0
                else:
                    same += 1
            if op == "D":
                md, same = md + f"{same}^{'T' * n}", 0
        reads.append(("chr1", rng.randint(1, 50), "".join(ops), md + str(same), seq, rng.choice([0, 16])))
    want = {}
    for c, s, cigar, md, seq, flag in reads:
        for p, b, _ in mismatches(s, cigar, md, seq, flag == 16):
            want[p, b] = want.get((p, b), 0) + 1
    df = spark.createDataFrame(reads, "contig string, pos_start int, cigar string, tag_md string, seq string, flag int")
    assert {(r.pos, r.base): r.n for r in mismatch_counts(df).collect()} == want and len(want) > 100
