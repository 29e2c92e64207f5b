"""Maps of base counts and base qualities, as Catalyst expressions.

Quality arrays are indexed by the quality, quality maps are keyed by its character (quality + 33). A null map gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _histogram(a: Column) -> Column:
    """Array of counts to a map of quality character to count, without zeros."""
    entries = F.transform(a, lambda n, i: F.struct(F.char(i + 33).alias("key"), n.cast("int").alias("value")))
    return F.map_from_entries(F.filter(entries, lambda x: x["value"] > 0))


def quals_to_map(quals: Column | str) -> Column:
    """Base → array of counts to base → map of quality character → count."""
    return F.transform_values(_c(quals), lambda _, v: _histogram(v))


def to_charmap(quals: Column | str) -> Column:
    """``quals_to_map`` with byte keys (character codes) as characters."""
    return F.transform_keys(quals_to_map(quals), lambda k, _: F.char(k.cast("int")))


def quals_to_cov(quals: Column | str, coverage: Column | str) -> Column:
    """The sum of all counts; the coverage where there are no qualities."""
    q = _c(quals)
    total = F.aggregate(F.map_values(q), F.lit(0), lambda acc, v: acc + F.aggregate(v, F.lit(0), lambda a, n: a + n.cast("int")))
    return F.when(q.isNull(), _c(coverage).cast("int")).otherwise(total)


def cov_equals(a: Column | str, b: Column | str) -> Column:
    return _c(a) == _c(b)


def alts_to_char(alts: Column | str) -> Column:
    """Byte keys (character codes) of a count map as characters."""
    return F.transform_keys(_c(alts), lambda k, _: F.char(k.cast("int")))


quals_to_char = alts_to_char


def alt_total(alts: Column | str) -> Column:
    """The sum of the counts; 0 for a null map."""
    return F.coalesce(F.aggregate(F.map_values(_c(alts)), F.lit(0), lambda acc, n: acc + n.cast("int")), F.lit(0))


def _sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def altmap_to_str(alts: Column | str) -> Column:
    """``(A,1)(c,2)``, in order of the key."""
    return F.array_join(F.transform(_sorted_entries(_c(alts)), lambda x: F.concat(F.lit("("), x["key"], F.lit(","), x["value"].cast("string"), F.lit(")"))), "")


def qualsmap_to_str(quals: Column | str) -> Column:
    """``(A,(F,2)(I,1))``, in order of the keys."""
    return F.array_join(F.transform(_sorted_entries(_c(quals)), lambda x: F.concat(F.lit("("), x["key"], F.lit(","), altmap_to_str(x["value"]), F.lit(")"))), "")


_HISTOGRAM = "map_from_entries(filter(transform({0}, (n, i) -> struct(char(i + 33), CAST(n AS INT))), x -> x.col2 > 0))"
_ENTRIES = "array_sort(map_entries({0}), (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)"
_ALTS = "array_join(transform(" + _ENTRIES + ", {1} -> concat('(', {1}.key, ',', CAST({1}.value AS STRING), ')')), '')"
#: SQL functions: name, parameters, result, body.
REGISTERED = (
    ("quals_to_map", "q MAP<STRING, ARRAY<INT>>", "MAP<STRING, MAP<STRING, INT>>", "transform_values(q, (k, v) -> " + _HISTOGRAM.format("v") + ")"),
    ("to_charmap", "q MAP<INT, ARRAY<INT>>", "MAP<STRING, MAP<STRING, INT>>", "transform_keys(transform_values(q, (k, v) -> " + _HISTOGRAM.format("v") + "), (k, v) -> char(k))"),
    ("quals_to_cov", "q MAP<STRING, ARRAY<INT>>, c INT", "INT", "CASE WHEN q IS NULL THEN c ELSE aggregate(map_values(q), 0, (t, v) -> t + aggregate(v, 0, (a, n) -> a + n)) END"),
    ("cov_equals", "a INT, b INT", "BOOLEAN", "a = b"),
    ("alts_to_char", "m MAP<INT, INT>", "MAP<STRING, INT>", "transform_keys(m, (k, v) -> char(k))"),
    ("quals_to_char", "m MAP<INT, MAP<STRING, INT>>", "MAP<STRING, MAP<STRING, INT>>", "transform_keys(m, (k, v) -> char(k))"),
    ("altmap_to_str", "m MAP<STRING, INT>", "STRING", _ALTS.format("m", "x")),
    ("qualsmap_to_str", "m MAP<STRING, MAP<STRING, INT>>", "STRING", "array_join(transform(" + _ENTRIES.format("m") + ", y -> concat('(', y.key, ',', " + _ALTS.format("y.value", "x") + ", ')')), '')"),
)


def register(spark: SparkSession) -> None:
    for name, parameters, result, body in REGISTERED:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
