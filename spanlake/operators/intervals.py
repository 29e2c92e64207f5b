"""Joins of closed integer intervals.

``binned`` (the default) gives each interval a level by its length: at level k the axis is cut into bins of 4^k times the
least bin, so an interval touches at most two bins of its own level or a higher one. It stands in the bins of its own
level, and in those of each higher level that the other side has; a pair meets at the higher of its two levels, in its
first shared bin there, so it comes out once without a DISTINCT. Spark sees an equi-join on the keys and the bin, whose
groups don't grow with a whole contig, and the longest interval is some tens of rows. Which levels a side has is a scalar
over two of its columns, worked out with the query; a side that is costly to make twice can be left unmeasured.

``hash`` joins on the keys alone with the overlap as a residual, which is less work where the groups of a key are small.
How large they are on the right is asked for when it is planned; where a key has more than some tens of rows, its work
would grow with the product of both groups, and the bins are taken.
Which side is broadcast, and what is skewed, Spark decides by the measured sizes; ``broadcast_right`` asks for it where
the caller knows a bound.

Counting needs no pairs (``overlap_counts``): of the intervals of a key, those that overlap [s, e] are the ones that start
up to e less the ones that end before s, and both are running sums over sorted positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least bin, and how many levels there are; each has bins four times as long as the one before. ``LONG_LEVELS`` is for
#: values of 64 bits, where an interval can be as long as all of them.
BIN, LEVELS, LONG_LEVELS = 64, 15, 29
#: ``hash``: the most rows of a key on the right for which it joins on the keys alone, and of all keys for which a right side in
#: bins may be broadcast.
GROUP, FEW = 64, 100_000
SPAN = ("pos_start", "pos_end")
TILE_BITS = 16


class _Bins:
    """Keys of bins: the bin's number times 32, plus its level."""

    def __init__(self, least: int, levels: int = LEVELS):
        self.bits, self.levels_in_all = max(4, (least - 1).bit_length()), levels

    def level(self, start: Column, end: Column) -> Column:
        """The first level whose bins are as long as the interval."""
        length = end.cast("double") - start.cast("double") + 1
        # a logarithm, not a list of cases: the code that Spark makes of it stays short enough for the JVM to compile
        return F.greatest(F.lit(0), F.least(F.lit(self.levels_in_all - 1), F.ceil((F.log2(length) - self.bits) / 2))).cast("int")

    def level_of(self, length: int) -> int:
        return max(0, min(self.levels_in_all - 1, -(-((length - 1).bit_length() - self.bits) // 2)))

    def key(self, position: Column, level: Column) -> Column:
        return F.call_function("shiftright", position.cast("bigint"), (level * 2 + self.bits).cast("int")) * 32 + level

    def levels(self, others: DataFrame | None, start: Column, end: Column) -> Column:
        """For each level, itself and the higher ones that the intervals of ``others`` have: a scalar, or a constant of all levels.

        A table of 15 short lists, worked out once, so that no row runs a function over an array.
        """
        every = range(self.levels_in_all)
        if others is None:
            return self.levels_of((1 << self.levels_in_all) - 1)
        meets = lambda own: lambda k: (k == own) | ((k > own) & (F.call_function("shiftright", F.col("mask"), k) % 2 == 1))
        return self.mask(others, start, end).select(F.array(*(F.filter(F.array(*map(F.lit, every)), meets(own)) for own in every)).alias("levels")).scalar()

    def mask(self, df: DataFrame, start: Column, end: Column) -> DataFrame:
        """One row: ``mask``, whose bits are the levels that ``df`` has."""
        bit = F.call_function("shiftleft", F.lit(1), self.level(start, end))
        return df.where(end >= start).agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("mask"))

    def levels_of(self, mask: int) -> Column:
        n = self.levels_in_all
        return F.array(*(F.array(*(F.lit(k) for k in range(own, n) if k == own or mask >> k & 1)) for own in range(n)))

    def repeated(self, df: DataFrame, start: Column, end: Column, levels: Column, level: str, bin_: str) -> DataFrame:
        """``df`` with a row for each bin: the interval's own ``level``, and ``bin_``."""
        at = df.withColumn(level, self.level(start, end)).withColumn("_k", F.explode(F.element_at(levels, F.col(level) + 1)))
        return at.withColumn(bin_, F.explode(F.sequence(self.key(start, F.col("_k")), self.key(end, F.col("_k")), F.lit(32).cast("bigint")))).drop("_k")


def _renamed(left: DataFrame, right: DataFrame, suffix: str) -> dict[str, str]:
    taken, out = set(left.columns), {}
    for c in right.columns:
        new = c
        while new in taken:
            new += suffix
        taken.add(new)
        out[c] = new
    return out


def _group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """The most rows of ``df`` with equal keys, and all its rows; those with a null key don't count."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    most, total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    return most or 0, total or 0


def interval_join(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...] | list[tuple[str, str]] = ("contig",), how: str = "inner", left_span: tuple[str, str] = SPAN, right_span: tuple[str, str] = SPAN,
    min_overlap: int = 1, max_gap: int = 0, plan: str = "binned", bin_size: int = BIN, broadcast_right: bool = False, suffix: str = "_right", measured: tuple[str, ...] = ("left", "right"), right_longest: int | None = None,
    left_longest: int | None = None, shuffled: bool = False, levels: int = LEVELS,
) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys whose intervals share ``min_overlap`` positions, or lie at most ``max_gap`` apart.

    ``keys`` are names, or pairs of names where they differ; none is allowed. ``how``: inner, left, right, full, left_semi,
    left_anti. A right column whose name the left has gets ``suffix``. Repeated rows stay repeated. A null key or bound,
    or an inverted interval, matches nothing (outer and anti joins keep its row). With a ``max_gap`` above 0 and
    ``min_overlap`` 1 the intervals needn't overlap. Empty tables give what SQL gives. ``bin_size`` is the least bin, of
    ``levels`` sizes; sides that aren't in ``measured`` are taken to have intervals of every length, or of up to ``left_longest`` and
    ``right_longest`` positions, where the caller knows it (1 for points). ``shuffled`` keeps Spark from broadcasting a side
    by the size of its files, which says little of its rows in bins.
    """
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    if plan not in ("binned", "hash"):
        raise ValueError(f"plan: {plan}")
    names = _renamed(left, right, suffix)
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    pairs = [(a, names[b]) for a, b in pairs]
    every = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    span2 = (names[right_span[0]], names[right_span[1]])
    s1, e1 = (F.col(c) for c in left_span)
    s2, e2 = (F.col(c) for c in span2)
    right = every.where(e2 >= s2)
    fits = (e1 + max_gap >= s2) & (s1 - max_gap <= e2) & (s1 <= e1)
    if min_overlap > 1:
        fits &= F.least(e1, e2) - F.greatest(s1, s2) + 1 >= min_overlap
    kinds = {kind for _, kind in [*left.select(s1, e1).dtypes, *every.select(s2, e2).dtypes]}
    if plan == "hash" and kinds <= {"tinyint", "smallint", "int", "bigint"} and not left.isStreaming and not right.isStreaming:
        most, total = _group_sizes(right, [b for _, b in pairs])
        if most > GROUP:
            plan, levels, shuffled = "binned", LONG_LEVELS if "bigint" in kinds else LEVELS, shuffled or total > FEW
    hinted = F.broadcast if broadcast_right else lambda df: df.hint("merge") if shuffled else df
    equal = [F.col(a) == F.col(b) for a, b in pairs]
    if plan == "hash":
        condition = fits & (e2 >= s2)
        for e in equal:
            condition = e & condition
        return left.join(hinted(right if how in ("inner", "left", "left_semi", "left_anti") else every), condition, how)
    same = {"left_span": left_span, "right_span": span2, "min_overlap": min_overlap, "max_gap": max_gap, "bin_size": bin_size, "broadcast_right": broadcast_right, "measured": measured, "right_longest": right_longest, "left_longest": left_longest, "shuffled": shuffled, "levels": levels}
    if how in ("left", "right", "full"):
        out = interval_join(left, every, pairs, **same)
        if how != "right":
            out = out.unionByName(interval_join(left, every, pairs, "left_anti", **same), allowMissingColumns=True)
        if how != "left":
            turned = same | {"left_span": span2, "right_span": left_span, "broadcast_right": False, "right_longest": None, "left_longest": None, "measured": tuple({"left": "right", "right": "left"}[m] for m in measured)}
            out = out.unionByName(interval_join(every, left, [(b, a) for a, b in pairs], "left_anti", **turned), allowMissingColumns=True)
        return out
    bins = _Bins(bin_size, levels)
    from2, to2 = s2.cast("bigint") - max_gap, e2.cast("bigint") + max_gap
    levels1 = bins.levels(left if "left" in measured else None, s1, e1) if left_longest is None else bins.levels_of((2 << bins.level_of(left_longest)) - 1)
    levels2 = bins.levels(right if "right" in measured else None, from2, to2) if right_longest is None else bins.levels_of((2 << bins.level_of(right_longest + 2 * max_gap)) - 1)
    # the keys and the bin are one number, which joins faster; the condition tests the keys themselves
    place1, place2 = (F.xxhash64(*(F.col(p[i]) for p in pairs), F.col(c)) for i, c in ((0, "_bin1"), (1, "_bin2")))
    binned_right = bins.repeated(right, from2, to2, levels1, "_lv2", "_bin2").withColumn("_place2", place2)
    met = F.col("_place1") == F.col("_place2")
    for e in equal:
        met = met & e
    met = met & fits & (F.col("_bin1") == F.col("_bin2"))
    binned = bins.repeated(left.where(s1 <= e1) if how == "inner" else left.where(s1 <= e1).withColumn("_row", F.monotonically_increasing_id()), s1, e1, levels2, "_lv1", "_bin1").withColumn("_place1", place1)
    if how == "inner":
        once = F.col("_bin1") == bins.key(F.greatest(s1.cast("bigint"), from2), F.greatest("_lv1", "_lv2"))
        return binned.join(hinted(binned_right), met & once).drop("_bin1", "_bin2", "_lv1", "_lv2", "_place1", "_place2")
    # an interval may match in several of its bins, or in some only: it is gathered by its own number, given once
    whole = F.struct(*left.columns)
    if how == "left_semi":
        return binned.join(hinted(binned_right), met, how).groupBy("_row").agg(F.first(whole).alias("_whole")).select("_whole.*")
    found = hinted(binned_right.select("_place2", "_bin2", *span2, *(b for _, b in pairs)).withColumn("_hit", F.lit(1)))
    gathered = binned.join(found, met, "left").groupBy("_row").agg(F.first(whole).alias("_whole"), F.max("_hit").alias("_hit"))
    return gathered.where(F.col("_hit").isNull()).select("_whole.*").unionByName(left.where(~F.coalesce(s1 <= e1, F.lit(False))))


def _counted(intervals: DataFrame, targets: DataFrame, max_gap: int) -> DataFrame:
    """The distinct rows of ``targets`` that aren't inverted, with ``_m``, how often each comes, and ``_n``, the intervals that it overlaps."""
    columns = targets.columns
    s, e = (F.col(c).cast("bigint") for c in SPAN)
    point = lambda p, a, b: F.struct(p.alias("p"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
    points = intervals.where(F.col("contig").isNotNull() & (s <= e)).select("contig", F.explode(F.array(point(s, 1, 0), point(e, 0, 1))).alias("_x")).groupBy("contig", F.col("_x.p").alias("p")).agg(F.sum("_x.a").alias("a"), F.sum("_x.b").alias("b"))
    asked = F.explode(F.array(F.struct((e + max_gap).alias("p"), F.lit(1).alias("sign")), F.struct((s - max_gap - 1).alias("p"), F.lit(-1).alias("sign"))))
    asked = targets.where(F.col("contig").isNotNull() & (s <= e)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_m")).select("contig", F.struct(*columns, "_m").alias("_whole"), asked.alias("_x"))
    asked = asked.select("contig", F.col("_x.p").alias("p"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("_x.sign").alias("_sign"), "_whole")
    rows = points.select("contig", "p", "a", "b").unionByName(asked, allowMissingColumns=True)
    # never null, so that both uses of the points are the same and share one shuffle
    rows = rows.withColumn("_tile", F.shiftright(F.coalesce("p", F.lit(0).cast("bigint")), TILE_BITS))
    order = Window.partitionBy("contig").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = rows.groupBy("contig", "_tile").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("contig", "_tile", F.coalesce(F.sum("a").over(order), F.lit(0)).alias("_a"), F.coalesce(F.sum("b").over(order), F.lit(0)).alias("_b"))
    w = Window.partitionBy("contig", "_tile").orderBy("p")
    seen = rows.join(tiles, ["contig", "_tile"]).withColumns({"_a": F.col("_a") + F.sum("a").over(w), "_b": F.col("_b") + F.sum("b").over(w)}).where(F.col("_sign").isNotNull())
    return seen.groupBy("_whole").agg(F.sum(F.when(F.col("_sign") > 0, F.col("_a")).otherwise(-F.col("_b"))).alias("_n")).select("_whole.*", "_n")


def overlap_counts(intervals: DataFrame, targets: DataFrame, max_gap: int = 0, name: str = "n") -> DataFrame:
    """``targets`` with the number (bigint) of ``intervals`` of the same ``contig`` that overlap each, or lie at most ``max_gap`` apart.

    No pair is made: starts and ends are summed by position, and the targets' bounds are looked up in running sums over
    tiles of 65,536 positions and over the tiles' sums. Intervals with a null or inverted are left out; a target with a
    null contig or bound, or an inverted one, counts 0. Repeated targets come out repeated.
    """
    each = _counted(intervals, targets, max_gap).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))))
    good = F.col("contig").isNotNull() & (F.col(SPAN[0]) <= F.col(SPAN[1]))
    return each.select(*targets.columns, F.col("_n").alias(name)).unionByName(targets.where(~F.coalesce(good, F.lit(False))).withColumn(name, F.lit(0).cast("bigint")))


def feature_counts(reads: DataFrame, targets: DataFrame, by: tuple[str, ...] = (), max_gap: int = 0, **options) -> DataFrame:
    """The targets' columns, ``length`` and ``n_reads`` of the reads that overlap each, also by columns ``by`` of the reads.

    Repeated targets are counted as one with all their matches, as in SQL's GROUP BY; a target without reads has no row.
    Without ``by`` and further options of the join the reads are counted without pairing them (``overlap_counts``).
    """
    length = (F.col("pos_end") - F.col("pos_start") + 1).cast("int")
    if not by and not options:
        counted = _counted(reads, targets, max_gap).where("_n > 0")
        return counted.select(*targets.columns, (F.col("_n") * F.col("_m")).alias("n_reads"), length.alias("length"))
    joined = interval_join(reads.select("contig", *SPAN, *by), targets, suffix="_target", max_gap=max_gap, **options)
    names = _renamed(reads.select("contig", *SPAN, *by), targets, "_target")
    targets_of = [F.col(n).alias(c) for c, n in names.items()]
    counted = joined.groupBy(*by, *targets_of).agg(F.count(F.lit(1)).alias("n_reads"))
    return counted.withColumn("length", length)
