"""Aggregation through a join without the join's rows: results per key when a few keys hold most rows.

Both inputs are aggregated by the join key first (Spark does most of it before the shuffle, so a key with a third of all
rows arrives as one state for each map task). The compact states are joined, and what the join would have repeated is put
right by algebra: a count becomes the product of both counts, a sum is multiplied by the other side's count, a minimum or
maximum stays. Coarser groups are rolled up from the joined states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig
from spanlake.operators.runbitmap import alignment_spans, covered


@dataclass(frozen=True)
class Measure:
    """``kind`` (count, sum, min or max) of ``value`` under ``name``. A count counts rows where ``value`` isn't null."""

    name: str
    kind: str
    value: Column | None = None

    def state(self) -> Column:
        v = F.lit(1) if self.value is None else self.value
        if self.kind == "count":
            return F.count(v)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](v)


def _states(df: DataFrame, keys: dict[str, Column], measures: list[Measure], side: str) -> DataFrame:
    return df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.count(F.lit(1)).alias(f"_n{side}"), *(m.state().alias(f"_{side}_{m.name}") for m in measures))


def eager_join_aggregate(
    left: DataFrame, right: DataFrame, left_keys: dict[str, Column], right_keys: dict[str, Column], left_measures: list[Measure], right_measures: list[Measure],
    how: str = "inner", group: list[str] | None = None,
) -> DataFrame:
    """Aggregates of ``left JOIN right`` by the join key, or by the part ``group`` of it, without the joined rows.

    Columns: the group, ``n_left`` and ``n_right`` (rows of the input, once each), ``n_joined`` (rows of the join), and
    each measure over the joined rows under its name. ``how`` is ``inner``, ``left`` or ``full``; in an outer join a row
    without a partner counts once, as in SQL. A null in the key matches nothing, so an outer join keeps its rows, an
    inner one drops them. Only named expressions are read, so columns with the same name on both sides don't clash; empty
    inputs give an empty (``inner``, or ``left`` with an empty left side) or unmatched result.
    """
    keys = list(left_keys)
    a, b = _states(left, left_keys, left_measures, "l"), _states(right, right_keys, right_measures, "r")
    joined = a.join(b, keys, how)
    times, own = F.coalesce("_nr", F.lit(1)), F.coalesce("_nl", F.lit(1))
    out = []
    for side, measures, factor in (("l", left_measures, times), ("r", right_measures, own)):
        for m in measures:
            c = F.col(f"_{side}_{m.name}")
            out.append((m, c * factor if m.kind in ("count", "sum") else c))
    rolled = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    columns = [
        F.sum(F.coalesce("_nl", F.lit(0))).alias("n_left"), F.sum(F.coalesce("_nr", F.lit(0))).alias("n_right"), F.sum(own * times).alias("n_joined"),
        *((F.coalesce(rolled[m.kind](c), F.lit(0)) if m.kind == "count" else rolled[m.kind](c)).alias(m.name) for m, c in out),
    ]
    return joined.groupBy(*(group or keys)).agg(*columns)


def pair_keys() -> dict[str, Column]:
    return {"sample_id": F.col("sample_id"), "contig": plain_contig("contig")}


def pair_stats(alignment: DataFrame, coverage: DataFrame, group: list[str] | None = None, how: str = "left") -> DataFrame:
    """Per (sample_id, contig): rows of ``alignment``, blocks of ``coverage``, rows of their join and aggregates over it."""
    left = [Measure("n_mapq", "count", F.col("mapq")), Measure("sum_mapq", "sum", F.col("mapq").cast("bigint")), Measure("min_start", "min", F.col("pos_start")), Measure("max_end", "max", F.col("pos_end"))]
    right = [Measure("sum_coverage", "sum", F.col("coverage").cast("bigint")), Measure("max_coverage", "max", F.col("coverage"))]
    return eager_join_aggregate(alignment, coverage, pair_keys(), pair_keys(), left, right, how, group)


def pair_coverage(alignment: DataFrame, coverage: DataFrame) -> DataFrame:
    """``pair_stats`` with ``covered`` bases of each pair, whose states are run bitmaps by shard."""
    spans = covered(alignment_spans(alignment), ["sample_id", "contig"], "pos_start", "pos_end")
    return pair_stats(alignment, coverage).join(spans, ["sample_id", "contig"], "left")


def heavy_pairs(alignment: DataFrame, coverage: DataFrame, percent: int = 3) -> DataFrame:
    """``sample_id``, ``contig``, ``n_left``, ``n_right`` and ``n_joined`` of the pairs, neither part null, that hold at
    least ``percent`` % of all rows of ``alignment``.

    All pairs of both tables are stated and joined. The total is a scalar over the same joined states, every row counted,
    those with nulls too. Pairs with a null part are left out inside the comparison, not by a filter of their own: pushed
    below the join it would make the states of the total others than those of the pairs, and each table be read twice.
    """
    states = eager_join_aggregate(alignment, coverage, pair_keys(), pair_keys(), [], [], "full")
    total = states.agg(F.coalesce(F.sum("n_left"), F.lit(0)).alias("n")).scalar()
    named = F.when(F.col("sample_id").isNotNull() & F.col("contig").isNotNull(), F.col("n_left"))
    return states.where(named * 100 >= F.greatest(total * percent, F.lit(1)))
