import random
from collections import Counter, defaultdict

from spanlake.llm.packing import Plan, containers, pack


def sizes_of(spark, sizes):
    return spark.createDataFrame(sizes, "doc_id bigint, n_tokens int").selectExpr("*", "1 AS piece", "2 AS container", "3 AS _rank")


def check(spark, sizes, capacity, ranked_rows=50):
    got = pack(sizes_of(spark, sizes), capacity, ranked_rows).collect()
    used, pieces = Counter(), defaultdict(list)
    for r in got:
        if r.container is None:
            assert r.n_tokens == 0 and r.piece == 0
        else:
            assert 0 < r.n_tokens <= capacity
            used[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.n_tokens))
    assert not used or max(used.values()) <= capacity
    want = defaultdict(list)
    for i, n in sizes:
        n = n or 0
        want[i] += [(k, min(capacity, n - k * capacity)) for k in range(max(1, -(-n // capacity)))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return used


def test_whole_and_within_capacity(spark):
    rng = random.Random(8)
    sizes = [(i, rng.choice([None, 0, 1, 5, 33, 34, 50, 51, 67, 99, 100, 101, 250, rng.randint(1, 60)])) for i in range(900)] + [(7, 34)] * 40 + [(None, 20), (None, None)]
    used = check(spark, sizes, 100)
    assert sum(used.values()) / (100 * len(used)) > 0.97
    check(spark, [(i, 3000) for i in range(30)], 2048)
    assert check(spark, [(i, 1) for i in range(10)], 4) and len(check(spark, [(i, 1) for i in range(10)], 4)) == 3
    assert check(spark, [], 10) == Counter() and check(spark, [(1, None), (2, 0)], 10) == Counter()


def test_plan():
    rng = random.Random(2)
    for capacity in (10, 64, 2048):
        counts = Counter(rng.randint(1, capacity) for _ in range(5000))
        plan = Plan(counts, capacity)
        assert plan._used.tolist()[1:] == [counts[s] for s in range(1, capacity + 1)]
        used, large = Counter(), Counter()
        starts = defaultdict(list)
        for size, rank, first, each in sorted(plan.rows):
            starts[size].append((rank, first, each))
        for size, own in starts.items():
            for (rank, first, each), stop in zip(own, [*(r for r, _, _ in own[1:]), counts[size]], strict=True):
                for k in range(stop - rank):
                    used[first + k // each] += size
                    large[first + k // each] += size * 3 > capacity
        assert max(used.values()) <= capacity and max(large.values()) <= 2 and len(used) == plan.containers


def test_containers(spark):
    df = containers(pack(sizes_of(spark, [(1, 5), (2, 5), (3, 0)]), 10))
    assert [(r.n_items, r.used) for r in df.collect()] == [(2, 10)]
