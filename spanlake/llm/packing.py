"""Documents into containers of a fixed number of tokens, with as little room left as possible.

Sizes are whole numbers up to the capacity, so the number of items of each size says all that a packing needs. The plan
is made from these counts on the driver (at most ``capacity`` rows, whatever the corpus holds):

1. items above a third of the capacity fit at most twice into a container; from the largest down, each is matched with
   the largest partner that still fits;
2. smaller items, from the largest down, go into the least gap that holds them, as often as they fit, before a new
   container is opened.

Containers that are filled alike stand in the plan as one range, so a step treats a whole size, not an item. The plan
says, for each size, which ranks of it go to which range of containers; workers rank the items of a size and look their
container up by binary search. An item above the capacity is cut into full containers and a rest, which is packed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.tokenizer import token_counts
from spanlake.tables import checkpointed

CAPACITY = 2048
#: Items of one size that one task ranks, about.
RANKED_ROWS = 1_000_000


class Plan:
    """Rows ``(size, first rank, first container, items per container)``; ``containers`` in all."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.rows, self.containers = capacity, [], 0
        self._ranges: dict[int, list[tuple[int, int]]] = {}
        self._gaps: list[int] = []
        left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            left[size] = n
        self._used = np.zeros(capacity + 1, np.int64)
        self._match_large(left)
        for size in range(capacity // 3, 0, -1):
            self._best_fit(size, int(left[size]))

    def _open(self, n: int) -> int:
        self.containers += n
        return self.containers - n

    def _put(self, size: int, n: int, container: int, each: int) -> None:
        self.rows.append((size, int(self._used[size]), container, each))
        self._used[size] += n

    def _leave(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self._ranges:
                insort(self._gaps, gap)
                self._ranges[gap] = []
            self._ranges[gap].append((first, n))

    def _match_large(self, left: np.ndarray) -> None:
        least = self.capacity // 3 + 1
        for size in range(self.capacity, least - 1, -1):
            while left[size]:
                fit = np.flatnonzero(left[least : min(size, self.capacity - size) + 1])
                partner = least + int(fit[-1]) if len(fit) else 0
                if partner == size and left[size] > 1:
                    n = int(left[size]) // 2
                    first = self._open(n)
                    self._put(size, 2 * n, first, 2)
                    left[size] -= 2 * n
                elif partner == size:
                    below = np.flatnonzero(left[least:size])
                    partner = least + int(below[-1]) if len(below) else 0
                if partner and partner != size:
                    n = int(min(left[size], left[partner]))
                    first = self._open(n)
                    self._put(size, n, first, 1)
                    self._put(partner, n, first, 1)
                    left[size] -= n
                    left[partner] -= n
                elif not partner:
                    n = int(left[size])
                    first = self._open(n)
                    self._put(size, n, first, 1)
                    left[size] = 0
                self._leave(self.capacity - size - partner, first, n)

    def _best_fit(self, size: int, n: int) -> None:
        while n:
            at = bisect_left(self._gaps, size)
            if at == len(self._gaps):
                each = self.capacity // size
                gap, ranges = self.capacity, [(self._open(-(-n // each)), -(-n // each))]
            else:
                gap = self._gaps.pop(at)
                ranges = self._ranges.pop(gap)
                each = gap // size
            for first, m in ranges:
                full = min(m, n // each)
                if full:
                    self._put(size, full * each, first, each)
                    self._leave(gap - each * size, first, full)
                    n -= full * each
                if full < m and n and n < each:
                    self._put(size, n, first + full, n)
                    self._leave(gap - n * size, first + full, 1)
                    n, full = 0, full + 1
                if gap < self.capacity:
                    self._leave(gap, first + full, m - full)


def _place(plan: Plan):
    """Looks containers up: rows (doc_id, piece, n_tokens, _rank) to (doc_id, piece, n_tokens, container)."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 4)
    first_of = np.searchsorted(rows[:, 0], np.arange(plan.capacity + 2))
    width = int(rows[:, 1].max()) + 1 if len(rows) else 1
    key = rows[:, 0] * width + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("n_tokens").to_numpy().astype(np.int64), b.column("_rank").to_numpy().astype(np.int64)
            at = np.searchsorted(key, size * width + np.minimum(rank, width - 1), "right") - 1
            assert (at >= first_of[size]).all()
            yield pa.record_batch([b.column("doc_id"), b.column("piece"), b.column("n_tokens"), pa.array(rows[at, 2] + (rank - rows[at, 1]) // rows[at, 3])], names=["doc_id", "piece", "n_tokens", "container"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """``doc_id``, ``piece`` (int), ``n_tokens`` (int), ``container`` (bigint) for rows of ``doc_id``, ``n_tokens``.

    One row for each document; a document above the capacity has a row for each of its pieces, all but the last of the
    full capacity. A null or zero size takes no room and has a null container. Repeated rows are packed as often as they
    come; a null ``doc_id`` is packed like any other; an empty table gives no row. ``sizes`` is read three times.
    """
    n = F.col("n_tokens")
    pieces = F.when(n > capacity, F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    salts = max(1, -(-sizes.count() // ranked_rows))
    items = (
        sizes.where(n > 0).select("doc_id", n.cast("int").alias("_n"), F.explode(pieces).alias("piece"))
        .select("doc_id", "piece", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    )
    held = items.groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    counts = {r.n_tokens: r.n for r in held.groupBy("n_tokens").agg(F.sum("_rows").alias("n")).collect()}
    before = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    own = Window.partitionBy("n_tokens", "_salt").orderBy("doc_id", "piece")
    ranked = items.join(offsets, ["n_tokens", "_salt"]).select("doc_id", "piece", "n_tokens", (F.row_number().over(own) - 1 + F.col("_offset")).cast("bigint").alias("_rank"))
    placed = ranked.mapInArrow(_place(Plan(counts, capacity)), "doc_id bigint, piece int, n_tokens int, container bigint")
    empty = sizes.where(n.isNull() | (n <= 0)).select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("bigint").alias("container"))
    return placed.union(empty)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of the documents' sizes in tokens, which are kept in the shared folder."""
    return pack(checkpointed(token_counts(documents)), capacity)


def containers(packed: DataFrame) -> DataFrame:
    """``container``, ``n_items``, ``used`` (tokens) of each container."""
    return packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used"))
