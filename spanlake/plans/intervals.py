"""Queries of interval functions, interval joins, coverage and pileup, and the same in SQL.

Reads and targets are derived from the star schema with integers only, so that both engines see the same; ``alignment``
and ``bed_feature`` serve where a query needs CIGAR strings, flags or mixed spelling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import ranges
from spanlake.functions.contigs import chr_contig, plain_contig
from spanlake.functions.quality import altmap_to_str
from spanlake.operators import coverage as cov
from spanlake.operators.intervals import feature_counts, interval_join
from spanlake.operators.pileup import pileup
from spanlake.plans.problems import PLAIN
from spanlake.tables import dealt, table

READS = """SELECT CAST(l_suppkey % 5 AS VARCHAR(10)) AS contig, CAST(l_partkey AS INT) AS pos_start, CAST(l_partkey + CAST(l_quantity AS INT) - 1 AS INT) AS pos_end,
  l_returnflag AS strand, l_linestatus AS sample_id, l_linenumber AS n FROM lineitem"""
TARGETS = "SELECT CAST(p_partkey % 5 AS VARCHAR(10)) AS contig, CAST(p_partkey AS INT) AS pos_start, CAST(p_partkey + p_size - 1 AS INT) AS pos_end, p_brand AS name FROM part"


def _n(c: str):
    return F.col(c).cast("int")


def reads(spark: SparkSession, d: str) -> DataFrame:
    li = dealt(table(spark, d, "lineitem"))
    return li.select((F.col("l_suppkey") % 5).cast("string").alias("contig"), _n("l_partkey").alias("pos_start"), (F.col("l_partkey") + _n("l_quantity") - 1).cast("int").alias("pos_end"), F.col("l_returnflag").alias("strand"), F.col("l_linestatus").alias("sample_id"), F.col("l_linenumber").alias("n"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 5).cast("string").alias("contig"), _n("p_partkey").alias("pos_start"), (F.col("p_partkey") + F.col("p_size") - 1).cast("int").alias("pos_end"), F.col("p_brand").alias("name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# interval functions over the targets -------------------------------------------------------------------------------

_FUNCTIONS = {
    "fn_shift": (lambda: ranges.shift("pos_start", "pos_end", 5), "s + 5", "e + 5"),
    "fn_resize_start": (lambda: ranges.resize("pos_start", "pos_end", 5, "start"), "s", "e + 5"),
    "fn_resize_end": (lambda: ranges.resize("pos_start", "pos_end", 5, "end"), "s - 5", "e"),
    "fn_resize_center": (lambda: ranges.resize("pos_start", "pos_end", 5, "center"), "s - 3", "s + 2 * ((e - s) // 2) + 2"),
    "fn_flank_start": (lambda: ranges.flank("pos_start", "pos_end", 5), "s - 5", "s - 1"),
    "fn_flank_end": (lambda: ranges.flank("pos_start", "pos_end", 5, False), "e + 1", "e + 5"),
    "fn_flank_both_start": (lambda: ranges.flank("pos_start", "pos_end", 5, True, True), "s - 5", "s + 4"),
    "fn_flank_both_end": (lambda: ranges.flank("pos_start", "pos_end", 5, False, True), "e - 4", "e + 5"),
    "fn_flank_negative_start": (lambda: ranges.flank("pos_start", "pos_end", -5), "s", "s + 4"),
    "fn_flank_negative_end": (lambda: ranges.flank("pos_start", "pos_end", -5, False), "e - 4", "e"),
    "fn_flank_negative_both": (lambda: ranges.flank("pos_start", "pos_end", -5, False, True), "e - 4", "e + 5"),
    "fn_promoters": (lambda: ranges.promoters("pos_start", "pos_end", 100, 20), "s - 100", "s + 19"),
    "fn_reflect": (lambda: ranges.reflect("pos_start", "pos_end", 11000, 15000), "26000 - e", "26000 - s"),
}


def _function(span: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: targets(spark, d).select("contig", "pos_start", "pos_end", span().alias("x")).select("contig", "pos_start", "pos_end", F.col("x.start").alias("new_start"), F.col("x.end").alias("new_end"))


for _name, (_span, _s, _e) in _FUNCTIONS.items():
    _add(_name, f"WITH t AS (SELECT contig, pos_start AS s, pos_end AS e FROM ({TARGETS})) SELECT contig, s AS pos_start, e AS pos_end, CAST({_s} AS INTEGER) AS new_start, CAST({_e} AS INTEGER) AS new_end FROM t")(_function(_span))


@_add("fn_contigs", f"SELECT contig, {PLAIN.format('contig')} AS plain, CASE WHEN contig IN ('M', 'MT') THEN 'chrM' WHEN contig LIKE 'chr%' THEN contig ELSE 'chr' || contig END AS prefixed, count(*) AS n FROM alignment GROUP BY ALL")
def fn_contigs(spark, d):
    return table(spark, d, "alignment").groupBy("contig", plain_contig("contig").alias("plain"), chr_contig("contig").alias("prefixed")).agg(F.count(F.lit(1)).alias("n"))


# joins -------------------------------------------------------------------------------------------------------------

_R, _T = f"WITH r AS ({READS}), t AS ({TARGETS})", "r.pos_end >= t.pos_start AND r.pos_start <= t.pos_end"


def _by_target(joined: DataFrame) -> DataFrame:
    shared = ranges.overlap_length("pos_start", "pos_end", "t_start", "t_end")
    return joined.groupBy("t_contig", "t_start", "t_end", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(shared.cast("bigint")).alias("shared"))


def _by_target_sql(condition: str) -> str:
    return f"""{_R} SELECT t.contig AS t_contig, t.pos_start AS t_start, t.pos_end AS t_end, name, count(*) AS n, CAST(sum(least(r.pos_end, t.pos_end) - greatest(r.pos_start, t.pos_start) + 1) AS BIGINT) AS shared
      FROM r JOIN t ON {condition} GROUP BY ALL"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    t = targets(spark, d).select(F.col("contig").alias("t_contig"), F.col("pos_start").alias("t_start"), F.col("pos_end").alias("t_end"), "name")
    return reads(spark, d), t


def _joined(keyed: bool = True, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        r, t = _sides(spark, d)
        return _by_target(interval_join(r, t, [("contig", "t_contig")] if keyed else [], right_span=("t_start", "t_end"), **options))

    return run


_EQ = f"r.contig = t.contig AND {_T}"
_add("iv_overlap_join", _by_target_sql(_EQ))(_joined())
_add("iv_overlap_hash", _by_target_sql(_EQ))(_joined(plan="hash"))
_add("iv_join_order", _by_target_sql(_EQ))(_joined(broadcast_right=True))
_add("iv_overlap_noeq", _by_target_sql(_T))(_joined(keyed=False))
_add("iv_min_overlap", _by_target_sql(f"{_EQ} AND least(r.pos_end, t.pos_end) - greatest(r.pos_start, t.pos_start) + 1 >= 10"))(_joined(min_overlap=10))
_add("iv_max_gap", _by_target_sql("r.contig = t.contig AND r.pos_end + 20 >= t.pos_start AND r.pos_start - 20 <= t.pos_end"))(_joined(max_gap=20))


@_add("iv_feature_counts", f"""{_R} SELECT t.contig, t.pos_start, t.pos_end, name, count(*) AS n_reads, t.pos_end - t.pos_start + 1 AS length FROM r JOIN t ON {_EQ} GROUP BY ALL""")
def iv_feature_counts(spark, d):
    return feature_counts(reads(spark, d), targets(spark, d))


@_add("iv_multisample_counts", f"{_R} SELECT r.sample_id, t.contig, t.pos_start, t.pos_end, name, count(*) AS n_reads, t.pos_end - t.pos_start + 1 AS length FROM r JOIN t ON {_EQ} GROUP BY ALL")
def iv_multisample_counts(spark, d):
    return feature_counts(reads(spark, d), targets(spark, d), ("sample_id",))


def _existing(how: str, size: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        few = targets(spark, d).where(F.col("pos_end") - F.col("pos_start") < size)
        return interval_join(targets(spark, d), few.select("contig", (F.col("pos_start") + 2).alias("s"), (F.col("pos_end") + 2).alias("e")), how=how, right_span=("s", "e"))

    return run


_FEW = f"WITH t AS ({TARGETS}), f AS (SELECT contig AS c, pos_start + 2 AS s, pos_end + 2 AS e FROM t WHERE pos_end - pos_start < 3)"
_FIT = "f.c = t.contig AND f.e >= t.pos_start AND f.s <= t.pos_end"
_add("iv_subset_by_overlaps", f"{_FEW} SELECT * FROM t WHERE EXISTS (SELECT 1 FROM f WHERE {_FIT})")(_existing("left_semi", 3))
_add("iv_anti", f"{_FEW} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE {_FIT})")(_existing("left_anti", 3))
_add("iv_left", f"{_FEW} SELECT t.*, f.c AS contig_right, f.s, f.e FROM t LEFT JOIN f ON {_FIT}")(_existing("left", 3))


@_add("iv_grange", f"{_R} SELECT r.* FROM r WHERE r.contig = '1' AND r.pos_end >= 101 AND r.pos_start <= 140")
def iv_grange(spark, d):
    one = spark.range(1).select(F.lit("1").alias("contig"), F.lit(101).alias("pos_start"), F.lit(140).alias("pos_end"))
    return interval_join(reads(spark, d), one, plan="hash").drop("contig_right", "pos_start_right", "pos_end_right")


@_add("iv_first_overlapper", f"{_R} SELECT t.contig, t.pos_start, t.pos_end, name, min(r.pos_start) AS first_start, max(r.pos_end) AS last_end FROM r JOIN t ON {_EQ} GROUP BY ALL")
def iv_first_overlapper(spark, d):
    r, t = _sides(spark, d)
    j = interval_join(r, t, [("contig", "t_contig")], right_span=("t_start", "t_end"))
    return j.groupBy(F.col("t_contig").alias("contig"), F.col("t_start").alias("pos_start"), F.col("t_end").alias("pos_end"), "name").agg(F.min("pos_start").alias("first_start"), F.max("pos_end").alias("last_end"))


@_add("iv_annotate", f"""WITH a AS (SELECT DISTINCT {PLAIN.format("contig")} AS contig, pos_start, pos_end FROM alignment WHERE pos_end >= pos_start)
  SELECT b.name, count(*) AS n, min(a.pos_start) AS first_start FROM bed_feature b JOIN a ON a.contig = {PLAIN.format("b.contig")} AND a.pos_end + 100000 >= b.pos_start AND a.pos_start - 100000 <= b.pos_end GROUP BY 1""")
def iv_annotate(spark, d):
    a = table(spark, d, "alignment").where("pos_end >= pos_start").select(plain_contig("contig").alias("contig"), "pos_start", "pos_end").distinct()
    b = table(spark, d, "bed_feature").select(plain_contig("contig").alias("contig"), "pos_start", "pos_end", "name")
    return interval_join(b, a, max_gap=100_000).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("pos_start_right").alias("first_start"))


# coverage ----------------------------------------------------------------------------------------------------------


def _blocks_sql(source: str, by: str = "contig", zero: bool = False) -> str:
    """Blocks of ``source`` (columns of by, s, e)."""
    return f"""ev AS (SELECT {by}, s AS p, 1 AS d FROM ({source}) UNION ALL SELECT {by}, e + 1, -1 FROM ({source})),
      pt AS (SELECT {by}, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0),
      bl AS (SELECT {by}, p AS pos_start, CAST(lead(p) OVER w - 1 AS INTEGER) AS pos_end, CAST(sum(d) OVER w AS INTEGER) AS coverage FROM pt WINDOW w AS (PARTITION BY {by} ORDER BY p)),
      blocks AS (SELECT {by}, pos_start, pos_end, 'R' AS ref, coverage FROM bl WHERE coverage {">=" if zero else ">"} 0 AND pos_end IS NOT NULL)"""


_SPANS = "SELECT contig, sample_id, pos_start AS s, pos_end AS e FROM r WHERE pos_start < pos_end"
_BLOCKS = f"WITH r AS ({READS}), {_blocks_sql(_SPANS)}"


@_add("cov_blocks", f"{_BLOCKS} SELECT * FROM blocks")
def cov_blocks(spark, d):
    return cov.coverage(reads(spark, d))


@_add("cov_samples", f"WITH r AS ({READS}), {_blocks_sql(_SPANS, 'sample_id, contig')} SELECT * FROM blocks")
def cov_samples(spark, d):
    return cov.coverage(reads(spark, d), ("sample_id", "contig"))


@_add("cov_bases", f"{_BLOCKS} SELECT contig, CAST(p AS INTEGER) AS pos_start, CAST(p AS INTEGER) AS pos_end, ref, coverage FROM (SELECT *, unnest(generate_series(pos_start, pos_end)) AS p FROM blocks)")
def cov_bases(spark, d):
    return cov.per_base(cov_blocks(spark, d))


@_add("cov_windows", f"""{_BLOCKS} SELECT contig, CAST(w * 100 + 1 AS INTEGER) AS pos_start, CAST(w * 100 + 100 AS INTEGER) AS pos_end, CAST(sum(coverage) AS DOUBLE) / 100 AS coverage
  FROM (SELECT contig, coverage, CAST(floor((unnest(generate_series(pos_start, pos_end)) - 1) / 100.0) AS BIGINT) AS w FROM blocks) GROUP BY contig, w""")
def cov_windows(spark, d):
    return cov.windows(cov_blocks(spark, d), 100)


@_add("cov_zero_blocks", f"""WITH r AS ({READS}), ends AS (SELECT contig, max(pos_end) + 10 AS n FROM r GROUP BY 1), ev AS (SELECT contig, s AS p, 1 AS d, 0 AS k FROM ({_SPANS}) UNION ALL SELECT contig, e + 1, -1, 0 FROM ({_SPANS})
   UNION ALL SELECT contig, 1, 0, 1 FROM ends UNION ALL SELECT contig, n + 1, 0, 1 FROM ends),
  pt AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0 OR max(k) = 1),
  bl AS (SELECT contig, p AS pos_start, CAST(lead(p) OVER w - 1 AS INTEGER) AS pos_end, CAST(sum(d) OVER w AS INTEGER) AS coverage FROM pt WINDOW w AS (PARTITION BY contig ORDER BY p))
  SELECT contig, pos_start, pos_end, 'R' AS ref, coverage FROM bl WHERE pos_end IS NOT NULL""")
def cov_zero_blocks(spark, d):
    r = reads(spark, d)
    return cov.coverage(r, contigs=r.groupBy("contig").agg((F.max("pos_end") + 10).alias("n_bases")))


_FILTERED = f"""WITH a AS (SELECT {PLAIN.format("contig")} AS contig, pos_start, pos_end, flag, mapq, cigar FROM alignment
   WHERE contig IS NOT NULL AND pos_start < pos_end AND flag & 1796 = 0 AND mapq >= 20),
  ids AS (SELECT *, row_number() OVER () AS rid FROM a),
  o AS (SELECT rid, contig, pos_start, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op FROM ids),
  q AS (SELECT *, CAST(left(op, length(op) - 1) AS INTEGER) AS n, right(op, 1) AS k FROM o),
  z AS (SELECT *, pos_start + coalesce(sum(CASE WHEN k IN ('M', '=', 'X', 'N', 'D') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM q),
  m AS (SELECT contig, CAST(here AS INTEGER) AS s, CAST(here + n - 1 AS INTEGER) AS e FROM z WHERE k IN ('M', '=', 'X')), {_blocks_sql("SELECT contig, s, e FROM m")} SELECT * FROM blocks"""


@_add("cov_filtered", _FILTERED)
def cov_filtered(spark, d):
    return cov.coverage(dealt(table(spark, d, "alignment")), min_mapq=20)


@_add("cov_spliced", f"""WITH r AS ({READS}), sp AS (SELECT contig, pos_start AS s, pos_end AS e FROM r UNION ALL SELECT contig, pos_end + 1 + n, pos_end + n + (pos_end - pos_start + 1) FROM r), {_blocks_sql("SELECT contig, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM sp")} SELECT * FROM blocks""")
def cov_spliced(spark, d):
    q = F.col("pos_end") - F.col("pos_start") + 1
    r = reads(spark, d).withColumn("cigar", F.concat(q, F.lit("M"), F.col("n"), F.lit("N"), q, F.lit("M")))
    return cov.coverage(r.withColumn("pos_end", (F.col("pos_end") + F.col("n") + q).cast("int")))


@_add("cov_target_stats", f"""{_BLOCKS}, t AS ({TARGETS}), j AS (SELECT t.*, coverage, least(b.pos_end, t.pos_end) - greatest(b.pos_start, t.pos_start) + 1 AS n FROM blocks b JOIN t ON b.contig = t.contig AND b.pos_end >= t.pos_start AND b.pos_start <= t.pos_end)
  SELECT contig, name, pos_start, pos_end, CAST(sum(n) AS BIGINT) AS n_bases, min(coverage) AS min_depth, CAST(sum(n * coverage) AS DOUBLE) / sum(n) AS mean_depth, max(coverage) AS max_depth FROM j GROUP BY ALL HAVING CAST(sum(n * coverage) AS DOUBLE) / sum(n) > 20""")
def cov_target_stats(spark, d):
    return cov.target_depth(cov_blocks(spark, d), targets(spark, d).distinct(), above=20)


# pileup: each read has one mismatch, C in the reference, at its place n (within the read) ---------------------------

_MARKED = f"""WITH r AS (SELECT contig, pos_start, pos_end, n, CASE sample_id WHEN 'O' THEN 'a' ELSE 'A' END AS base FROM ({READS}) WHERE pos_start < pos_end),
  alt AS (SELECT contig, CAST(pos_start + least(n, pos_end - pos_start) AS INTEGER) AS p, base, count(*) AS n FROM r GROUP BY ALL),
  ev AS (SELECT contig, pos_start AS p, 1 AS d, 0 AS k FROM r UNION ALL SELECT contig, pos_end + 1, -1, 0 FROM r UNION ALL SELECT contig, p, 0, 1 FROM alt UNION ALL SELECT contig, p + 1, 0, 1 FROM alt),
  pt AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0 OR max(k) = 1),
  bl AS (SELECT contig, p AS pos_start, CAST(lead(p) OVER w - 1 AS INTEGER) AS pos_end, CAST(sum(d) OVER w AS INTEGER) AS coverage FROM pt WINDOW w AS (PARTITION BY contig ORDER BY p)),
  am AS (SELECT contig, p, string_agg('(' || base || ',' || n || ')', '' ORDER BY base) AS alts, CAST(sum(n) AS INTEGER) AS n FROM alt GROUP BY ALL)
  SELECT bl.contig, pos_start, pos_end, CASE WHEN am.p IS NULL THEN 'R' ELSE 'C' END AS ref, coverage, CAST(coverage - coalesce(n, 0) AS INTEGER) AS countRef, coalesce(n, 0) AS countNonRef, alts"""


def marked_reads(spark, d):
    q = (F.col("pos_end") - F.col("pos_start") + 1).cast("int")
    k = F.least(F.col("n"), q - 1).cast("int")
    r = reads(spark, d)
    return r.select(
        "contig", "pos_start", "pos_end", F.concat(q, F.lit("M")).alias("cigar"), F.concat(k, F.lit("C"), q - k - 1).alias("tag_md"), F.repeat(F.lit("A"), q).alias("seq"),
        F.repeat(F.char(F.col("n") + 33), q).alias("qual"), F.when(F.col("sample_id") == "O", 16).otherwise(0).alias("flag"),
    )


@_add("pileup_alts", f"{_MARKED} FROM bl LEFT JOIN am ON bl.contig = am.contig AND bl.pos_start = am.p WHERE coverage > 0 AND pos_end IS NOT NULL")
def pileup_alts(spark, d):
    return pileup(marked_reads(spark, d)).drop("quals").withColumn("alts", altmap_to_str("alts"))


@_add("pileup_quals", f"""WITH r AS (SELECT contig, pos_start, pos_end, n, CASE sample_id WHEN 'O' THEN 'a' ELSE 'A' END AS base FROM ({READS}) WHERE pos_start < pos_end),
  alt AS (SELECT DISTINCT contig, CAST(pos_start + least(n, pos_end - pos_start) AS INTEGER) AS p FROM r)
  SELECT r.contig, p AS pos_start, base, n AS q, CAST(count(*) AS INTEGER) AS reads FROM r JOIN alt ON r.contig = alt.contig AND p BETWEEN r.pos_start AND r.pos_end GROUP BY ALL""")
def pileup_quals(spark, d):
    by_base = pileup(marked_reads(spark, d), quals=True).select("contig", "pos_start", F.explode("quals").alias("base", "counts"))
    return by_base.select("contig", "pos_start", "base", F.posexplode("counts").alias("q", "reads")).where("reads > 0")


# what Spark itself brings, as users of the engine run it -------------------------------------------------------------


def _sql(query: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        for n in names:
            table(spark, d, n).createOrReplaceTempView(n)
        return spark.sql(query)

    return run


for _name, _query, _tables in (
    ("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("lineitem",)),
    ("sql_rollup", "SELECT sample_id, mapq, count(*) AS n FROM alignment GROUP BY ROLLUP (sample_id, mapq)", ("alignment",)),
    ("sql_rank", "SELECT * FROM (SELECT sample_id, contig, count(*) AS n, CAST(rank() OVER (PARTITION BY contig ORDER BY count(*) DESC) AS BIGINT) AS r FROM alignment GROUP BY sample_id, contig) t WHERE r <= 3", ("alignment",)),
    ("sql_sets", "SELECT sample_id FROM alignment EXCEPT SELECT sample_id FROM coverage_block UNION (SELECT sample_id FROM alignment INTERSECT SELECT sample_id FROM coverage_block)", ("alignment", "coverage_block")),
    ("sql_distinct_samples", "SELECT DISTINCT sample_id FROM alignment", ("alignment",)),
    ("sql_having", "SELECT contig, avg(CAST(coverage AS DOUBLE)) AS mean FROM coverage_block WHERE coverage IS NOT NULL GROUP BY contig HAVING avg(coverage) > 20", ("coverage_block",)),
    ("sql_case_cast", "SELECT CASE WHEN flag & 16 = 16 THEN '-' ELSE '+' END AS strand, count(*) AS n, count(CASE WHEN mapq >= 30 AND mapq < 255 THEN 1 END) AS good FROM alignment GROUP BY 1", ("alignment",)),
):
    _add(_name, _query)(_sql(_query, *_tables))
