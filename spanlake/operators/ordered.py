"""Look-ups in an ordered set of closed intervals, as DataFrames: what an interval tree answers, without building one.

Intervals are ordered by start, then end. Each look-up is a filter that reaches the scan, with a minimum or a bounded sort
after it, so nothing is gathered. ``span`` names the two columns; null bounds are never found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = ("pos_start", "pos_end")


def _at(span: tuple[str, str]) -> tuple[Column, Column]:
    return F.col(span[0]), F.col(span[1])


def _overlaps(span: tuple[str, str], start: int, end: int) -> Column:
    s, e = _at(span)
    return (s <= end) & (e >= start)


def put(df: DataFrame, values: list[str], span: tuple[str, str] = SPAN) -> DataFrame:
    """One row for each interval, with the sorted ``values`` of all its rows; an inverted interval raises."""
    s, e = _at(span)
    checked = df.withColumn(span[0], F.when(s > e, F.raise_error(F.lit("start after end"))).otherwise(s))
    return checked.groupBy(*span).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("held"))


def remove(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    s, e = _at(span)
    return df.where(~F.coalesce((s == start) & (e == end), F.lit(False)))


def find(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    s, e = _at(span)
    return df.where((s == start) & (e == end))


def _distinct(df: DataFrame, span: tuple[str, str]) -> DataFrame:
    return df.select(*span).dropna().distinct()


def find_by_index(df: DataFrame, index: int, span: tuple[str, str] = SPAN) -> DataFrame:
    """The interval with this place (from 0) among the distinct ones."""
    return _distinct(df, span).orderBy(*span).offset(index).limit(1)


def index_of(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    """``index``: the place (from 0) of an interval among the distinct ones, -1 if it isn't there."""
    s, e = _at(span)
    before = (s < start) | ((s == start) & (e < end))
    held = _distinct(df, span).agg(F.count_if(before).alias("n"), F.max(F.when((s == start) & (e == end), 1)).alias("there"))
    return held.select(F.when(F.col("there") == 1, F.col("n")).otherwise(-1).cast("bigint").alias("index"))


def _one(df: DataFrame, span: tuple[str, str], last: bool = False) -> DataFrame:
    place = F.struct(*(F.col(c) for c in span))
    return df.dropna(subset=list(span)).agg((F.max if last else F.min)(place).alias("_at")).where(F.col("_at").isNotNull()).select("_at.*")


def least(df: DataFrame, start: int | None = None, end: int | None = None, span: tuple[str, str] = SPAN) -> DataFrame:
    """The first interval, or the first that is not before the one given."""
    s, e = _at(span)
    return _one(df if start is None else df.where((s > start) | ((s == start) & (e >= end))), span)


def greatest(df: DataFrame, start: int | None = None, end: int | None = None, span: tuple[str, str] = SPAN) -> DataFrame:
    """The last interval, or the last that is not after the one given."""
    s, e = _at(span)
    return _one(df if start is None else df.where((s < start) | ((s == start) & (e <= end))), span, True)


def overlappers(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    return df.where(_overlaps(span, start, end))


def first_overlapper(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    return _one(overlappers(df, start, end, span), span)


def overlappers_without_end(df: DataFrame, position: int, span: tuple[str, str] = SPAN) -> DataFrame:
    """Intervals that start at or before a position, wherever they end."""
    return df.where(F.col(span[0]) <= position)


def first_without_end(df: DataFrame, position: int, span: tuple[str, str] = SPAN) -> DataFrame:
    return _one(overlappers_without_end(df, position, span), span)


def first_exclude_left(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    """The first interval that overlaps and ends after ``start``, not only at it."""
    return _one(df.where(_overlaps(span, start, end) & (F.col(span[1]) > start)), span)


def overlappers_exclude_left(df: DataFrame, start: int, end: int, span: tuple[str, str] = SPAN) -> DataFrame:
    """The overlapping intervals from ``first_exclude_left`` on: the first must end after ``start``, the others overlap."""
    s, e = _at(span)
    first = first_exclude_left(df, start, end, span).select(F.struct(*span).alias("_at")).scalar()
    return df.where(_overlaps(span, start, end) & (F.struct(s, e) >= first))


def in_order(df: DataFrame, start: int | None = None, end: int | None = None, span: tuple[str, str] = SPAN, reverse: bool = False) -> DataFrame:
    """All intervals in order, or in reverse, from the given one on: a range-partitioned sort."""
    s, e = _at(span)
    if start is not None:
        df = df.where((s < start) | ((s == start) & (e <= end)) if reverse else (s > start) | ((s == start) & (e >= end)))
    return df.orderBy(*(c.desc() if reverse else c.asc() for c in (s, e)))


def relation(start1, end1, start2, end2) -> Column:
    """``before``, ``touching``, ``overlapping`` or ``after``: how the first interval lies to the second; touching ones have no base between them."""
    s1, e1, s2, e2 = (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x) for x in (start1, end1, start2, end2))
    return F.when((s1 <= e2) & (s2 <= e1), "overlapping").when((e1 + 1 == s2) | (e2 + 1 == s1), "touching").when(e1 < s2, "before").when(s1 > e2, "after")
