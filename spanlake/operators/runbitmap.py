"""Covered periods and gaps of positions per entity, through compressed run bitmaps.

Positions are discrete (bases, or any exact unit). The axis is cut into shards of 65,536 positions, and the covered
positions of one entity in one shard are one bitmap, kept as runs: pairs of two-byte numbers (first position in the
shard, length - 1). The steps:

1. each map task turns its spans into bitmaps and unions those of the same entity and shard (numpy, before the shuffle);
2. the bitmaps are shuffled by (entity, shard) and unioned, in two rounds: first ``FAN`` shares of a shard apart, then
   these. A task reads a shard's bitmaps in order, one after the other, and holds their union so far, so neither a row
   nor the memory of a task grows with the number of map tasks that saw the shard;
3. set runs and the clear runs between them are read off; only the runs at a shard's two ends go on, to be joined
   across shards by a window per entity.

A heavy entity is spread over its shards in 1 and 2, a heavy shard over its shares. Step 3's window holds at most two
rows for each shard, and as positions are 32-bit, an entity has at most 65,536 shards: no group grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig

SHARD_BITS = 16
_SHARD = 1 << SHARD_BITS
#: Spans that a map task gathers before it makes bitmaps of them.
BUFFER_ROWS = 400_000
#: Shares of a shard that are unioned apart before they are unioned with one another.
FAN = 32
#: Bitmaps that a union takes at once.
UNITED_ROWS = 4096


def _merge(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of closed spans per entity: sorted, disjoint, not touching."""
    if not len(entity):
        return entity, start, end
    order = np.lexsort((start, entity))
    entity, start, end = entity[order], start[order], end[order]
    # a key that grows with the entity makes one running maximum serve all entities
    width = int(max(end.max(), start.max())) - int(min(start.min(), end.min())) + 3
    base = entity.astype(np.int64) * width
    low = int(start.min())
    reach = np.maximum.accumulate(base + (end - low))
    new = np.ones(len(entity), bool)
    new[1:] = (base + (start - low))[1:] > reach[:-1] + 1
    new[1:] |= entity[1:] != entity[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(entity)) - 1
    return entity[at], start[at], reach[last] - base[last] + low


def _cut(entity: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans cut at shard borders: entity, shard, first and last position in the shard."""
    first, last = start >> SHARD_BITS, end >> SHARD_BITS
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    shard = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    low = shard << SHARD_BITS
    return entity[row], shard, np.maximum(start[row], low) - low, np.minimum(end[row], low + _SHARD - 1) - low


def _packed(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Runs sorted by group, as one binary value for each group; the row where each group begins."""
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    data = np.empty((len(start), 2), "<u2")
    data[:, 0], data[:, 1] = start, end - start
    offsets = np.append(at, len(start)).astype(np.int32) * 4
    return at, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (key columns, _s, _e) to one bitmap for each key and shard of a buffer."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names = table.schema.names[:-2]
        codes = [table.column(n).combine_chunks().dictionary_encode() for n in names]
        combined = np.zeros(table.num_rows, np.int64)
        for c in codes:
            combined = combined * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False)
        _, where, entity = np.unique(combined, return_index=True, return_inverse=True)
        got = _merge(entity, table.column("_s").to_numpy().astype(np.int64), table.column("_e").to_numpy().astype(np.int64))
        ent, shard, lo, hi = _cut(*got)
        at, runs = _packed(ent * (1 << 33) + shard, lo, hi)
        rows = where[ent[at]]
        return pa.record_batch([table.column(n).combine_chunks().take(pa.array(rows)) for n in names] + [pa.array(shard[at], pa.int32()), runs], names=[*names, "_shard", "_runs"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= BUFFER_ROWS:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def _spans_of(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of each bitmap: its row, first and last position in the shard."""
    sizes = pc.binary_length(runs).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    data = np.frombuffer(b"".join(runs.to_pylist()), "<u2").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(runs)), sizes), data[:, 0], data[:, 0] + data[:, 1]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps sorted by their key columns, to one bitmap for each key; the last key of a batch waits for the next batch."""
    held: pa.Table | None = None

    def union(t: pa.Table, keys: list[str]) -> pa.Table:
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            differs = [pc.not_equal(t.column(k).slice(1), t.column(k).slice(0, t.num_rows - 1)).to_numpy() for k in keys]
            new[1:] = np.logical_or.reduce(differs)
        row, start, end = _spans_of(t.column("_runs").combine_chunks())
        group, start, end = _merge((np.cumsum(new) - 1)[row], start, end)
        return t.select(keys).take(pa.array(np.flatnonzero(new))).append_column("_runs", _packed(group, start, end)[1])

    for whole in batches:
        keys = [n for n in whole.schema.names if n != "_runs"]
        for at in range(0, whole.num_rows, UNITED_ROWS):
            t = pa.Table.from_batches([whole.slice(at, UNITED_ROWS)])
            got = union(t if held is None else pa.concat_tables([held, t.cast(held.schema)]), keys)
            if got.num_rows > 1:
                yield from got.slice(0, got.num_rows - 1).combine_chunks().to_batches()
            held = got.slice(got.num_rows - 1)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's runs: ``period`` inside, ``gap`` between two runs, ``edge`` for the first and the last run."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            names = batch.schema.names[:-2]
            row, start, end = _spans_of(batch.column("_runs"))
            low = batch.column("_shard").to_numpy().astype(np.int64)[row] << SHARD_BITS
            start, end = start + low, end + low
            first = np.append(True, row[1:] != row[:-1])
            last = np.append(first[1:], True)
            edge, between = first | last, np.flatnonzero(~first)
            kind = np.concatenate([np.where(edge, "edge", "period"), np.full(len(between), "gap")])
            rows = pa.array(np.concatenate([row, row[between]]))
            s, e = np.concatenate([start, end[between - 1] + 1]), np.concatenate([end, start[between] - 1])
            columns = [pa.array(kind.astype(object), pa.string()), *(batch.column(n).take(rows) for n in [*names, "_shard"]), pa.array(s, pa.int32()), pa.array(e, pa.int32())]
            yield pa.record_batch(columns, names=["kind", *names, "_shard", "_s", "_e"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of set positions of each shard."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            row, start, end = _spans_of(batch.column("_runs"))
            n = np.bincount(row, end - start + 1, batch.num_rows).astype(np.int64)
            names = batch.schema.names[:-2]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n)], names=[*names, "_n"])


def _unite(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    schema = ", ".join(f"{k} {'string' if k[0] == 'k' else 'int'}" for k in keys)
    return bitmaps.select(*keys, "_runs").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_united, f"{schema}, _runs binary")


def run_bitmaps(spans: DataFrame, keys: list[str], start: str, end: str, fan: int = FAN) -> DataFrame:
    """``spans`` as bitmaps: one row for each entity and shard, with the keys as ``k0``, ``k1``..., ``_shard`` and ``_runs``.

    Rows with a null key, start or end, or with ``end`` before ``start``, are ignored. Other columns are dropped first,
    so that clashing names don't matter. Positions are cast to int.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    plain = spans.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(start).cast("int").alias("_s"), F.col(end).cast("int").alias("_e"))
    plain = plain.where(F.col("_e") >= F.col("_s")).dropna().select(*(F.col(k).cast("string").alias(k) for k in ks), "_s", "_e")
    parts = plain.mapInArrow(_bitmaps, f"{', '.join(f'{k} string' for k in ks)}, _shard int, _runs binary")
    shares = _unite(parts.withColumn("_fan", F.pmod(F.xxhash64("_runs"), F.lit(fan)).cast("int")), [*ks, "_shard", "_fan"])
    return _unite(shares, [*ks, "_shard"])


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str, end: str, max_gap: int | None = None) -> DataFrame:
    """``kind``, the keys (as strings), ``pos_start``, ``pos_end``: each maximal covered stretch as ``period``, each
    uncovered stretch between two of them as ``gap``.

    Touching spans (end + 1 = start) make one period. ``max_gap`` leaves out longer gaps. Repeated, nested and tied
    rows change nothing; for ignored rows see ``run_bitmaps``; an empty table gives no row.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    names = ", ".join(f"{k} string" for k in ks)
    runs = run_bitmaps(spans, keys, start, end).mapInArrow(_runs, f"kind string, {names}, _shard int, _s int, _e int")
    short = lambda length: F.lit(True) if max_gap is None else length <= max_gap
    inner = runs.where((F.col("kind") == "period") | ((F.col("kind") == "gap") & short(F.col("_e") - F.col("_s") + 1))).drop("_shard")
    w = Window.partitionBy(*ks).orderBy("_s")
    hole = F.col("_s") - F.col("_before") - 1
    span = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("_s"), e.cast("int").alias("_e"))
    edges = (
        runs.where("kind = 'edge'")
        .withColumn("_before", F.lag("_e").over(w)).withColumn("_at", F.lag("_shard").over(w))
        .withColumn("_new", F.col("_before").isNull() | (hole > 0))
        .withColumn("_first", F.max(F.when(F.col("_new"), F.col("_s"))).over(w))
        .withColumn("_ends", F.coalesce(F.lead("_new").over(w), F.lit(True)))
        .withColumn("_out", F.array(
            F.when(F.col("_ends"), span("period", F.col("_first"), F.col("_e"))),
            F.when(F.col("_new") & (F.col("_at") != F.col("_shard")) & (hole > 0) & short(hole), span("gap", F.col("_before") + 1, F.col("_s") - 1)),
        ))
        .select(*ks, F.explode(F.filter("_out", lambda x: x.isNotNull())).alias("_o"))
        .select("_o.kind", *ks, "_o._s", "_o._e")
    )
    return inner.union(edges).select("kind", *(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("_s").alias("pos_start"), F.col("_e").alias("pos_end"))


def covered(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The keys and ``covered`` (bigint), the number of positions that at least one span covers."""
    ks = [f"k{i}" for i in range(len(keys))]
    shards = run_bitmaps(spans, keys, start, end).mapInArrow(_counts, ", ".join(f"{k} string" for k in ks) + ", _n bigint")
    return shards.groupBy(*ks).agg(F.sum("_n").alias("covered")).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "covered")


def alignment_spans(alignment: DataFrame) -> DataFrame:
    return alignment.select("sample_id", plain_contig("contig").alias("contig"), "pos_start", "pos_end")
