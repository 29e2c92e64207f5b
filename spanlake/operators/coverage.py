"""Depth of coverage: in blocks, per base, in fixed windows, with uncovered stretches, per target.

A read adds 1 where an aligned stretch begins and takes it off after its end. These changes are summed per position before
anything is ordered, so what is shuffled doesn't grow with the depth. Running sums go in two steps: within tiles of 65,536
positions, and over the sums of the tiles, of which a contig of 32-bit positions has at most 65,536. No task holds a whole
contig's positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.alignment import aligned_blocks
from spanlake.functions.contigs import plain_contig
from spanlake.operators.intervals import interval_join

TILE_BITS = 16
#: Blocks are cut at multiples of so many positions (as a power of two) where they are joined with targets.
PIECE_BITS = 10
#: Reads with one of these flags are left out: unmapped, secondary, failed the checks, duplicate.
FILTER_FLAG = 1796


def usable(reads: DataFrame, filter_flag: int = FILTER_FLAG, min_mapq: int = 0) -> DataFrame:
    """Reads with a contig, none of the flags, a mapping quality of at least ``min_mapq``, and a start before their end.

    ``flag`` and ``mapq`` are tested where the columns exist; a null in a tested column leaves the read out.
    """
    test = F.col("contig").isNotNull() & (F.col("pos_start") < F.col("pos_end"))
    if "flag" in reads.columns:
        test &= F.col("flag").bitwiseAND(F.lit(filter_flag)) == 0
    if "mapq" in reads.columns and min_mapq > 0:
        test &= F.col("mapq") >= min_mapq
    return reads.where(test)


def _changes(spans: DataFrame, by: list[str], s: Column, e: Column) -> DataFrame:
    both = F.array(F.struct(s.cast("int").alias("p"), F.lit(1).alias("d")), F.struct((e + 1).cast("int").alias("p"), F.lit(-1).alias("d")))
    return spans.select(*by, F.explode(both).alias("_c")).select(*by, F.col("_c.p").alias("p"), F.col("_c.d").alias("d"), F.lit(0).alias("cut"))


def depth_blocks(changes: DataFrame, by: list[str], keep_zero: bool = False, carry: dict[str, Column] | None = None) -> DataFrame:
    """``by``, ``pos_start``, ``pos_end``, ``coverage`` from rows ``by``, ``p``, ``d`` (change of depth at p), ``cut`` (1: a block begins here in any case).

    ``carry`` names aggregates over the rows of a position, which go with the block that begins there.
    """
    carry = carry or {}
    points = changes.groupBy(*by, "p").agg(F.sum("d").alias("d"), F.max("cut").alias("cut"), *(c.alias(n) for n, c in carry.items())).where((F.col("d") != 0) | (F.col("cut") == 1)).drop("cut")
    # never null, so that no null test is pushed into one use of the points alone: both uses share one shuffle
    points = points.withColumn("_tile", F.shiftright(F.coalesce("p", F.lit(0)), TILE_BITS))
    order = Window.partitionBy(*by).orderBy("_tile")
    first = F.min(F.struct("p", *carry))["p"] if carry else F.min("p")  # reads what is carried, too, for the same reason
    tiles = (
        points.groupBy(*by, "_tile").agg(F.sum("d").alias("_sum"), first.alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_after", F.lead("_first").over(order)).drop("_sum", "_first")
    )
    w = Window.partitionBy(*by, "_tile").orderBy("p")
    blocks = points.join(tiles, [*by, "_tile"]).select(
        *by, F.col("p").alias("pos_start"), (F.coalesce(F.lead("p").over(w), F.col("_after")) - 1).cast("int").alias("pos_end"), (F.col("_before") + F.sum("d").over(w)).cast("int").alias("coverage"), *carry
    )
    return blocks.where(F.col("pos_end").isNotNull() & (F.col("coverage") >= 0 if keep_zero else F.col("coverage") > 0))


def aligned_changes(reads: DataFrame, by: list[str]) -> DataFrame:
    contig = [plain_contig("contig").alias("contig")] if "contig" in by else []
    rest = [b for b in by if b != "contig"]
    if "cigar" in reads.columns:
        spans = reads.select(*contig, *rest, F.explode(aligned_blocks("pos_start", "cigar")).alias("_b")).select(*by, "_b.s", "_b.e")
        return _changes(spans, by, F.col("s"), F.col("e"))
    return _changes(reads.select(*contig, *rest, "pos_start", "pos_end"), by, F.col("pos_start"), F.col("pos_end"))


def coverage(reads: DataFrame, by: tuple[str, ...] = ("contig",), filter_flag: int = FILTER_FLAG, min_mapq: int = 0, contigs: DataFrame | None = None) -> DataFrame:
    """``by`` (contigs plain), ``pos_start``, ``pos_end``, ``ref`` (``R``), ``coverage`` of every maximal run of equal depth above 0.

    Reads come as ``contig``, ``pos_start``, ``pos_end``, with ``cigar``, ``flag`` and ``mapq`` tested where they exist;
    see ``usable``. With ``contigs`` (``contig``, ``n_bases``) uncovered stretches come out too, as depth 0; by
    more than the contig, for the contigs that have reads there. Rows with a
    null in ``by`` are left out; an empty table gives no row.
    """
    by = list(by)
    changes = aligned_changes(usable(reads, filter_flag, min_mapq).dropna(subset=[b for b in by if b in reads.columns]), by)
    if contigs is not None:
        ends = contigs.select("contig", F.explode(F.array(F.lit(1), (F.col("n_bases") + 1).cast("int"))).alias("p"))
        if len(by) > 1:
            ends = changes.select(*by).distinct().join(ends, "contig")
        changes = changes.union(ends.select(*by, "p", F.lit(0).alias("d"), F.lit(1).alias("cut")))
    blocks = depth_blocks(changes, by, contigs is not None)
    return blocks.select(*by, "pos_start", "pos_end", F.lit("R").alias("ref"), "coverage")


def per_base(blocks: DataFrame) -> DataFrame:
    """One row for each position of the blocks."""
    return blocks.withColumn("_p", F.explode(F.sequence("pos_start", "pos_end"))).withColumns({"pos_start": F.col("_p"), "pos_end": F.col("_p")}).drop("_p")


def windows(blocks: DataFrame, size: int, by: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Mean depth of each window of ``size`` positions (1 to size, size + 1 to ...) with a covered position."""
    n = F.explode(F.sequence(F.floor((F.col("pos_start") - 1) / size), F.floor((F.col("pos_end") - 1) / size)))
    cut = blocks.select(*by, "pos_start", "pos_end", "coverage", n.alias("_w"))
    first, last = F.col("_w") * size + 1, F.col("_w") * size + size
    shared = F.least(F.col("pos_end"), last) - F.greatest(F.col("pos_start"), first) + 1
    return (
        cut.groupBy(*by, "_w").agg(F.sum(F.col("coverage").cast("bigint") * shared).alias("_bases"))
        .select(*by, first.cast("int").alias("pos_start"), last.cast("int").alias("pos_end"), (F.col("_bases") / size).alias("coverage"))
    )


def target_depth(blocks: DataFrame, targets: DataFrame, name: str = "name", above: float | None = None) -> DataFrame:
    """``contig``, the target's ``name``, and covered bases, least, mean and greatest depth over its covered bases; with ``above`` only targets of a greater mean depth.

    Long blocks are cut, which changes none of these: so a target stands in the bins of few levels, without the blocks being
    worked out twice to learn their lengths.
    """
    t = targets.select("contig", F.col("pos_start").alias("_ts"), F.col("pos_end").alias("_te"), F.col(name).alias("name"))
    size = 1 << PIECE_BITS
    first, last = (F.shiftright(c, PIECE_BITS) for c in ("pos_start", "pos_end"))
    pieces = blocks.select("contig", "pos_start", "pos_end", "coverage", F.explode(F.sequence(first, last)).alias("_k"))
    pieces = pieces.select("contig", F.greatest("pos_start", F.col("_k") * size).alias("pos_start"), F.least("pos_end", F.col("_k") * size + (size - 1)).alias("pos_end"), "coverage")
    j = interval_join(pieces, t, right_span=("_ts", "_te"), measured=("right",), left_longest=size, shuffled=True)
    n = (F.least("pos_end", "_te") - F.greatest("pos_start", "_ts") + 1).cast("bigint")
    out = j.groupBy("contig", "name", "_ts", "_te").agg(
        F.sum(n).alias("n_bases"), F.min("coverage").alias("min_depth"), (F.sum(n * F.col("coverage")) / F.sum(n)).alias("mean_depth"), F.max("coverage").alias("max_depth")
    ).select("contig", "name", F.col("_ts").alias("pos_start"), F.col("_te").alias("pos_end"), "n_bases", "min_depth", "mean_depth", "max_depth")
    return out if above is None else out.where(F.col("mean_depth") > above)
