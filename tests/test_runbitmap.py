import random

import numpy as np
import pyarrow as pa

from spanlake.operators.runbitmap import _united, covered, periods_and_gaps
from tests.conftest import rows


def brute(spans, max_gap):
    out = []
    for key in {(a, b) for a, b, s, e in spans if None not in (a, b, s, e) and e >= s}:
        merged = []
        for s, e in sorted((s, e) for a, b, s, e in spans if (a, b) == key and s is not None and e is not None and e >= s):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [("period", *key, s, e) for s, e in merged]
        out += [("gap", *key, a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:], strict=False) if max_gap is None or b[0] - a[1] - 1 <= max_gap]
    return sorted(out)


def frame(spark, spans):
    return spark.createDataFrame(spans, "a string, b string, s int, e int").selectExpr("*", "1 AS kind", "2 AS _shard", "3 AS _s")


def test_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(rng.choice("xyz"), rng.choice("12"), s := rng.randint(-300, 300_000), s + rng.choice([-1, 0, 5, 200, 70_000])) for _ in range(400)]
    spans += [("x", "1", 65_535, 65_535), ("x", "1", 65_536, 65_536), ("q", "1", 65_500, 65_535), ("q", "1", 65_536, 65_600), ("q", "1", 131_072, 131_072)] + spans[:50]
    spans += [(None, "1", 1, 2), ("x", None, 1, 2), ("x", "1", None, 2), ("x", "1", 1, None), ("w", "1", 0, 2_000_000), ("v", "9", 2_147_483_000, 2_147_483_647)]
    for gap in (None, 1000):
        assert rows(periods_and_gaps(frame(spark, spans), ["a", "b"], "s", "e", gap)) == brute(spans, gap)
    want = {}
    for _, a, b, s, e in (r for r in brute(spans, None) if r[0] == "period"):
        want[a, b] = want.get((a, b), 0) + e - s + 1
    assert {(r.a, r.b): r.covered for r in covered(frame(spark, spans), ["a", "b"], "s", "e").collect()} == want


def test_empty(spark):
    assert periods_and_gaps(frame(spark, []), ["a", "b"], "s", "e").count() == 0
    assert covered(frame(spark, []), ["a", "b"], "s", "e").count() == 0


def test_many_bitmaps_of_one_shard():
    """5,000 tasks saw the shard: what a union holds and gives is one bitmap, however many there are."""
    rng = np.random.default_rng(3)
    covers, batches = np.zeros(65_536, bool), []
    for _ in range(50):
        runs = []
        for _ in range(100):
            start = np.sort(rng.choice(60_000, 40, replace=False))
            for at in start:
                covers[at : at + 6] = True
            runs.append(np.stack([start, np.full(40, 5)], 1).astype("<u2").tobytes())
        batches.append(pa.record_batch({"k0": ["x"] * 100, "_shard": pa.array([7] * 100, pa.int32()), "_runs": runs}))
    batches.append(pa.record_batch({"k0": ["y"], "_shard": pa.array([7], pa.int32()), "_runs": [np.array([[1, 0]], "<u2").tobytes()]}))
    out = [r for b in _united(iter(batches)) for r in b.to_pylist()]
    assert [(r["k0"], r["_shard"]) for r in out] == [("x", 7), ("y", 7)] and max(len(r["_runs"]) for r in out) <= 4 * 32_768
    got = np.zeros(65_536, bool)
    for s, n in np.frombuffer(out[0]["_runs"], "<u2").reshape(-1, 2).astype(int):
        got[s : s + n + 1] = True
    assert (got == covers).all()
    assert list(_united(iter([]))) == []


def test_fan(spark):
    spans = [("x", "1", i, i + 3) for i in range(0, 9000, 5)]
    want = brute(spans, None)
    assert rows(periods_and_gaps(frame(spark, spans).repartition(40), ["a", "b"], "s", "e")) == want
