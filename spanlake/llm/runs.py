"""Runs of like consecutive blocks, each as one block with its count and length.

The axis of each entity is cut into chunks of 65,536 positions. A chunk's distinct blocks are gathered into one sorted
array (duplicates go before the shuffle). Where a block doesn't continue the one before it, a run starts: the starts are
gathered into the chunk's sorted array of boundaries, every block finds its boundary by binary search, and the blocks of
a boundary are aggregated. Only a chunk's first and last run can go on in another chunk; those are joined by a window per
entity, which holds at most two rows for each chunk (32-bit positions have at most 65,536), so no group grows with the
rows. A heavy entity is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig

CHUNK_BITS = 16
_COLUMNS = "sample_id string, contig string, run_start int, run_end int, n_blocks bigint, bases bigint, first_cov int, last_cov int, min_cov int, max_cov int, _chunk int, _first boolean, _last boolean"


def _continues(before_end, start, before_cov, cov, tolerance):
    return (start == before_end + 1) & (np.abs(cov - before_cov) <= tolerance)


def _runs(tolerance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                blocks = batch.column("_blocks")
                sizes = pc.list_value_length(blocks).to_numpy(zero_copy_only=False)
                flat = blocks.flatten()
                start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                cov = flat.field(2).to_numpy(zero_copy_only=False).astype(float)  # a null is NaN and continues nothing
                chunk = np.repeat(np.arange(batch.num_rows), sizes)
                place = np.arange(len(chunk))
                new = np.ones(len(chunk), bool)
                new[1:] = (chunk[1:] != chunk[:-1]) | ~_continues(end[:-1], start[1:], cov[:-1], cov[1:], tolerance)
                boundaries = np.flatnonzero(new)  # sorted places of the run starts
                mine = np.searchsorted(boundaries, place, "right") - 1
                n = np.bincount(mine, minlength=len(boundaries)).astype(np.int64)
                bases = np.bincount(mine, end - start + 1, len(boundaries)).astype(np.int64)
                last = np.append(boundaries[1:], len(chunk)) - 1
                owner = chunk[boundaries]
                ends = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
                begins = np.append(True, ends[:-1]) if len(owner) else ends
                value = lambda x: pa.array(np.where(np.isnan(x), 0, x).astype(np.int32), pa.int32(), mask=np.isnan(x))
                low = np.minimum.reduceat(cov, boundaries) if len(boundaries) else cov
                high = np.maximum.reduceat(cov, boundaries) if len(boundaries) else cov
                rows = pa.array(owner)
                columns = [
                    batch.column("sample_id").take(rows), batch.column("contig").take(rows), pa.array(start[boundaries], pa.int32()), pa.array(end[last], pa.int32()), pa.array(n), pa.array(bases),
                    value(cov[boundaries]), value(cov[last]), value(low), value(high), batch.column("_chunk").take(rows), pa.array(begins), pa.array(ends),
                ]
                yield pa.record_batch(columns, names=["sample_id", "contig", "run_start", "run_end", "n_blocks", "bases", "first_cov", "last_cov", "min_cov", "max_cov", "_chunk", "_first", "_last"])

    return run


def coverage_runs(blocks: DataFrame, tolerance: int = 1) -> DataFrame:
    """``sample_id``, ``contig`` (plain), ``run_start``, ``run_end``, ``n_blocks``, ``bases``, ``min_cov``, ``max_cov`` of every run.

    In order of pos_start (ties by pos_end, then coverage, null first), a block continues the run of the block before it
    if it starts one after that block's end, neither coverage is null and they differ by at most ``tolerance``. Rows with
    a null sample_id, contig, pos_start or pos_end are ignored; rows equal in sample_id, plain contig, positions and
    coverage count once; a block with null coverage is a run by itself. Other columns are dropped first; an empty table
    gives no row. A run whose blocks start where another begins (ties) keeps its own blocks.
    """
    b = blocks.select(F.col("sample_id").cast("string").alias("sample_id"), plain_contig("contig").alias("contig"), F.col("pos_start").cast("int").alias("s"), F.col("pos_end").cast("int").alias("e"), F.col("coverage").cast("int").alias("c"))
    b = b.where(F.col("sample_id").isNotNull() & F.col("contig").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull())
    chunks = b.groupBy("sample_id", "contig", F.shiftright("s", CHUNK_BITS).alias("_chunk")).agg(F.array_sort(F.collect_set(F.struct("s", "e", "c"))).alias("_blocks"))
    runs = chunks.mapInArrow(_runs(tolerance), _COLUMNS)
    out = ["sample_id", "contig", "run_start", "run_end", "n_blocks", "bases", "min_cov", "max_cov"]
    inner = runs.where(~F.col("_first") & ~F.col("_last")).select(*out)
    w = Window.partitionBy("sample_id", "contig").orderBy("_chunk", F.col("_last"), "run_start")
    joined = F.col("_first") & (F.lag("run_end").over(w) + 1 == F.col("run_start")) & (F.abs(F.lag("last_cov").over(w) - F.col("first_cov")) <= tolerance)
    edges = (
        runs.where("_first or _last")
        .withColumn("_new", ~F.coalesce(joined, F.lit(False)))
        .withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("sample_id", "contig", "_run")
        .agg(F.min_by("run_start", F.struct("_chunk", "_last", "run_start")).alias("run_start"), F.max_by("run_end", F.struct("_chunk", "_last", "run_start")).alias("run_end"), *(f(c).alias(c) for f, c in ((F.sum, "n_blocks"), (F.sum, "bases"), (F.min, "min_cov"), (F.max, "max_cov"))))
        .select(*out)
    )
    return inner.union(edges)


def repeated_runs(blocks: DataFrame, tolerance: int = 1) -> DataFrame:
    """Runs of two or more blocks."""
    return coverage_runs(blocks, tolerance).where("n_blocks >= 2")
