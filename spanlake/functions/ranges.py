"""Arithmetic on closed integer intervals, as Catalyst expressions; ``REGISTERED`` has the same for SQL.

A null argument gives a null part. Positions stay int; the sums follow the session's overflow rule.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _half(n: Column) -> Column:
    """Half, towards zero."""
    return ((n - n % 2) / 2).cast("int")


def shift(start, end, n) -> Column:
    start, end, n = _c(start), _c(end), _c(n)
    return _span(start + n, end + n)


def resize(start, end, n, fix: str = "center") -> Column:
    """Longer by ``n``, with the ``start``, the ``end`` or (any other word, any case) the centre held."""
    start, end, n = _c(start), _c(end), _c(n)
    if fix.lower() == "start":
        return _span(start, end + n)
    if fix.lower() == "end":
        return _span(start - n, end)
    half = _half(end - start)
    centre, less = start + half, _half(n)
    return _span(centre - half - less - F.when(n % 2 == 0, 0).otherwise(1), centre + half + less)


def overlap_length(start1, end1, start2, end2) -> Column:
    """Shared positions; zero or less says how far two intervals without any are apart."""
    return (F.least(_c(end1), _c(end2)) - F.greatest(_c(start1), _c(start2)) + 1).cast("int")


def flank(start, end, width, at_start: bool = True, both: bool = False) -> Column:
    """The stretch beside an edge; a negative width lies inside; ``both`` straddles the edge."""
    start, end, width = _c(start), _c(end), _c(width)
    size = F.abs(width)
    if both:
        first = start - size if at_start else end - size + 1
        return _span(first, first + 2 * size - 1)
    outside = start - width if at_start else end + 1
    inside = start if at_start else end + width + 1
    first = F.when(width >= 0, outside).otherwise(inside)
    return _span(first, first + size - 1)


def promoters(start, end, upstream, downstream) -> Column:
    """``upstream`` before the start to ``downstream`` after it; a negative length raises."""
    start, up, down = _c(start), _c(upstream), _c(downstream)
    bad = (up < 0) | (down < 0)
    return F.when(bad, F.raise_error(F.lit("upstream and downstream must not be negative"))).otherwise(_span(start - up, start + down - 1))


def reflect(start, end, bound_start, bound_end) -> Column:
    """Mirrored within the bounds."""
    start, end, low, high = _c(start), _c(end), _c(bound_start), _c(bound_end)
    first = 2 * low + (high - low) - end
    return _span(first, first + end - start)


_SPAN = "STRUCT<start: INT, end: INT>"
_PAIR = "named_struct('start', {0}, 'end', {1})"
#: SQL functions: name, parameters, result, body.
REGISTERED = (
    ("shift", "s INT, e INT, n INT", _SPAN, _PAIR.format("s + n", "e + n")),
    ("resize", "s INT, e INT, n INT, fix STRING", _SPAN,
     f"CASE lower(fix) WHEN 'start' THEN {_PAIR.format('s', 'e + n')} WHEN 'end' THEN {_PAIR.format('s - n', 'e')} ELSE "
     + _PAIR.format("CAST(s - n DIV 2 - abs(n % 2) AS INT)", "CAST(s + 2 * ((e - s) DIV 2) + n DIV 2 AS INT)") + " END"),
    ("overlap", "s1 INT, e1 INT, s2 INT, e2 INT", "INT", "least(e1, e2) - greatest(s1, s2) + 1"),
    ("overlaplength", "s1 INT, e1 INT, s2 INT, e2 INT", "INT", "least(e1, e2) - greatest(s1, s2) + 1"),
    ("flank", "s INT, e INT, n INT, at_start BOOLEAN, both BOOLEAN", _SPAN,
     f"CASE WHEN both AND at_start THEN {_PAIR.format('s - abs(n)', 's + abs(n) - 1')} WHEN both THEN {_PAIR.format('e - abs(n) + 1', 'e + abs(n)')} "
     f"WHEN at_start AND n >= 0 THEN {_PAIR.format('s - n', 's - 1')} WHEN at_start THEN {_PAIR.format('s', 's - n - 1')} "
     f"WHEN n >= 0 THEN {_PAIR.format('e + 1', 'e + n')} ELSE {_PAIR.format('e + n + 1', 'e')} END"),
    ("promoters", "s INT, e INT, up INT, down INT", _SPAN,
     f"CASE WHEN up < 0 OR down < 0 THEN raise_error('upstream and downstream must not be negative') ELSE {_PAIR.format('s - up', 's + down - 1')} END"),
    ("reflect", "s INT, e INT, low INT, high INT", _SPAN, _PAIR.format("low + high - e", "low + high - s")),
)


def register(spark: SparkSession, prefixes: tuple[str, ...]) -> None:
    for prefix in prefixes:
        for name, parameters, result, body in REGISTERED:
            if prefix + name == "reflect":  # Spark has a function of this name, which stays; the prefixed one is ours
                continue
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}grange(c STRING, s INT, e INT) RETURNS TABLE (contig STRING, pos_start INT, pos_end INT) RETURN SELECT c, s, e"
        )
