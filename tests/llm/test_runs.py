import random

from spanlake.llm.runs import coverage_runs, repeated_runs
from tests.conftest import rows


def brute(blocks, tolerance=1):
    plain = lambda c: "MT" if (b := c.removeprefix("chr")) == "M" else b
    own = {}
    for s, c, a, e, v in blocks:
        if None not in (s, c, a, e):
            own.setdefault((s, plain(c)), set()).add((a, e, v))
    out = []
    for key, held in own.items():
        run = None
        for a, e, v in sorted(held, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)):
            if run and a == run[-1][1] + 1 and v is not None and run[-1][2] is not None and abs(v - run[-1][2]) <= tolerance:
                run.append((a, e, v))
            else:
                run = [(a, e, v)]
                out.append((key, run))
    values = lambda r: [v for _, _, v in r if v is not None] or [None]
    return sorted(((*k, r[0][0], r[-1][1], len(r), sum(e - a + 1 for a, e, _ in r), min(values(r)), max(values(r))) for k, r in out), key=lambda t: tuple((x is not None, x) for x in t))


def frame(spark, blocks):
    return spark.createDataFrame(blocks, "sample_id string, contig string, pos_start int, pos_end int, coverage int").selectExpr("*", "1 AS _chunk", "2 AS run_start", "3 AS n_blocks")


def test_against_brute_force(spark):
    rng = random.Random(3)
    blocks = []
    for sample in ("a", "b"):
        at, cov = 1, 10
        for _ in range(1500):
            length = rng.choice([1, 7, 60, 900])
            cov = max(0, cov + rng.choice([-3, -1, 0, 0, 1, 1]))
            blocks.append((sample, rng.choice(["chr1", "1"]), at, at + length - 1, rng.choice([cov] * 9 + [None])))
            at += length + rng.choice([0, 0, 0, 0, 1, 30_000])
    blocks += rng.sample(blocks, 400)
    blocks += [("t", "M", 10, 20, 5), ("t", "M", 10, 25, 5), ("t", "chrM", 26, 30, 5), ("t", "MT", 5, 9, 4)]  # ties
    blocks += [("u", "1", 65_530 + i, 65_530 + i, 3) for i in range(12)] + [("u", "1", 131_072 - 65_530, 131_071, 4)] + [("w", "1", i * 65_536, i * 65_536 + 65_535, 9) for i in range(5)]
    blocks += [(None, "1", 1, 2, 3), ("a", None, 1, 2, 3), ("n", "1", 1, 2, None), ("n", "1", 3, 4, None), ("i", "1", 5, 4, 1), ("i", "1", 5, 9, 1)]
    rng.shuffle(blocks)
    assert rows(coverage_runs(frame(spark, blocks))) == brute(blocks)
    assert rows(repeated_runs(frame(spark, blocks), 3)) == [r for r in brute(blocks, 3) if r[4] > 1]


def test_empty(spark):
    assert coverage_runs(frame(spark, [])).count() == 0
