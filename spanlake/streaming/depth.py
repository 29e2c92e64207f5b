"""Depth over a stream of reads: the changes are summed by Structured Streaming, blocks are made of the sums on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.coverage import aligned_changes, depth_blocks, usable


def change_counts(reads: DataFrame, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """``by``, ``p``, ``d``: the change of depth at each position so far, for a sink in update or complete mode.

    The state is one number for each position where reads begin or end, whatever the depth.
    """
    return aligned_changes(usable(reads), list(by)).groupBy(*by, "p").agg(F.sum("d").alias("d"))


def blocks_of(counts: DataFrame, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """The blocks of what the sink holds."""
    return depth_blocks(counts.withColumn("cut", F.lit(0)), list(by))
