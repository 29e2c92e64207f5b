"""Queries of the general problems 1 to 3, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import eager, rejects, runbitmap
from spanlake.tables import table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rejects.read_with_rejects(table(spark, d, "bed_raw"), table(spark, d, "bed_source"), table(spark, d, "contig_list"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "alignment"), table(spark, d, "coverage_block")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_parsed(spark, d)).select("line_id", "reason")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return rejects.accepted(_parsed(spark, d)).drop("item_rgb", "block_sizes", "block_starts", "thick_start", "thick_end", "block_count")


def p1_typed(spark: SparkSession, d: str) -> DataFrame:
    """The records with all their fields; ``p1_records`` leaves out what is past the strand."""
    return rejects.accepted(_parsed(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).groupBy("source_file", F.coalesce("reason", F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return runbitmap.periods_and_gaps(runbitmap.alignment_spans(table(spark, d, "alignment")), ["sample_id", "contig"], "pos_start", "pos_end", 10_000)


def p2_covered(spark: SparkSession, d: str) -> DataFrame:
    return runbitmap.covered(runbitmap.alignment_spans(table(spark, d, "alignment")), ["sample_id", "contig"], "pos_start", "pos_end")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_pairs(*_pairs(spark, d)).select("sample_id", "contig")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return eager.pair_coverage(*_pairs(spark, d)).select("sample_id", "contig", "n_left", "n_right", F.col("n_joined").cast("bigint").alias("n_joined"), F.col("sum_mapq").cast("bigint").alias("sum_mapq"), "min_start", "max_end", F.col("sum_coverage").cast("bigint").alias("sum_coverage"), "max_coverage", "covered")


def p3_contigs(spark: SparkSession, d: str) -> DataFrame:
    return eager.pair_stats(*_pairs(spark, d), group=["contig"]).select("contig", "n_left", "n_right", F.col("n_joined").cast("bigint").alias("n_joined"), F.col("sum_coverage").cast("bigint").alias("sum_coverage"))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_typed, p1_reasons, p2_found, p2_covered, p3_found, p3_pairs, p3_contigs)}

PLAIN = "(CASE WHEN regexp_replace({0}, '^chr', '') = 'M' THEN 'MT' ELSE regexp_replace({0}, '^chr', '') END)"
_F = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
_UNQUOTED = "(CASE WHEN r.{0} LIKE '\"%' THEN replace(substr(r.{0}, 2, length(r.{0}) - 2), '\"\"', '\"') ELSE r.{0} END)"
_NAMES = ["c", "s", "e", "n", "sc", "st"]
_EXTRACT = "^" + r"(?:\t".join(f"({_F})" for _ in _NAMES) + ")?" * (len(_NAMES) - 1)
_PARSED = f"""WITH own AS (
  SELECT line_id, b.source_file, n_cols, regexp_replace(line, '\\r$', '') AS line FROM bed_raw b LEFT JOIN bed_source USING (source_file)
  WHERE line IS NOT NULL AND NOT regexp_full_match(line, '[\\s\\x{{a0}}]*') AND NOT regexp_matches(lower(line), '^(track|browser|#)')),
 cut AS (SELECT *, regexp_extract(line, '{_EXTRACT}', {_NAMES}) AS r, regexp_replace(line, '"(?:[^"]|"")*"', '', 'g') AS bare,
   regexp_full_match(line, '{_F}(?:\\t{_F})*') AS quoted FROM own),
 fields AS (SELECT *, {", ".join(f"{_UNQUOTED.format(n)} AS f_{n}" for n in _NAMES)} FROM cut),
 num AS (SELECT f.*, {PLAIN.format("f_c")} AS plain, {", ".join(f"CASE WHEN regexp_full_match(f_{n}, '[0-9]+') THEN TRY_CAST(f_{n} AS HUGEINT) END AS v_{n}" for n in ("s", "e", "sc"))} FROM fields f),
 parsed AS (SELECT num.*, CASE WHEN NOT quoted THEN 'quoting'
   WHEN n_cols IS NULL OR length(bare) - length(replace(bare, chr(9), '')) + 1 <> n_cols THEN 'column_count'
   WHEN contig_list.contig IS NULL THEN 'contig'
   WHEN v_s IS NULL OR v_s > 2147483647 THEN 'pos_start'
   WHEN v_e IS NULL OR v_e > 2147483647 OR v_e <= v_s OR v_e > n_bases THEN 'pos_end'
   WHEN n_cols >= 5 AND f_sc <> '.' AND (v_sc IS NULL OR v_sc > 1000) THEN 'score' END AS reason
  FROM num LEFT JOIN contig_list ON plain = contig_list.contig)
"""
_ALL = ["c", "s", "e", "n", "sc", "st", "ts", "te", "rgb", "bc", "bs", "bst"]
_EXTRACT_ALL = "^" + r"(?:\t".join(f"({_F})" for _ in _ALL) + ")?" * (len(_ALL) - 1)
_INT = r"CASE WHEN regexp_full_match({0}, '\s*[+-]?[0-9]+\s*') THEN TRY_CAST({0} AS INTEGER) END"
_INTS = f"CASE WHEN {{0}} <> '' THEN [{_INT.format('x')} FOR x IN string_split(regexp_replace({{0}}, ',$', ''), ',')] END"
_TYPED = f"""{_PARSED}, whole AS (SELECT * EXCLUDE (r), regexp_extract(line, '{_EXTRACT_ALL}', {_ALL}) AS r FROM parsed WHERE reason IS NULL),
 more AS (SELECT *, {", ".join(f"{_UNQUOTED.format(n)} AS g_{n}" for n in _ALL[6:])} FROM whole),
 lists AS (SELECT *, {", ".join(f"{_INTS.format(f'g_{n}')} AS l_{n}" for n in ("rgb", "bs", "bst"))} FROM more)
"""
_SPANS = f"""SELECT sample_id, {PLAIN.format("contig")} AS contig, pos_start AS s, pos_end AS e FROM alignment
  WHERE sample_id IS NOT NULL AND contig IS NOT NULL AND pos_start IS NOT NULL AND pos_end >= pos_start"""
_PERIODS = f"""WITH spans AS ({_SPANS}),
 reach AS (SELECT *, max(e) OVER (PARTITION BY sample_id, contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans),
 island AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach),
 period AS (SELECT sample_id, contig, min(s) AS pos_start, max(e) AS pos_end FROM island GROUP BY sample_id, contig, g)
"""
_STATES = f"""WITH a AS (SELECT sample_id, {PLAIN.format("contig")} AS contig, count(*) AS nl, sum(mapq) AS sum_mapq, min(pos_start) AS min_start, max(pos_end) AS max_end FROM alignment GROUP BY 1, 2),
 c AS (SELECT sample_id, {PLAIN.format("contig")} AS contig, count(*) AS nr, sum(coverage) AS sum_coverage, max(coverage) AS max_coverage FROM coverage_block GROUP BY 1, 2),
 j AS (SELECT a.*, nr, sum_coverage, max_coverage FROM a LEFT JOIN c ON a.sample_id = c.sample_id AND a.contig = c.contig)
"""

ORACLE = {
    "p1_found": f"{_PARSED} SELECT line_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p1_records": f"""{_PARSED} SELECT line_id, source_file, plain AS contig, CAST(v_s + 1 AS INTEGER) AS pos_start, CAST(v_e AS INTEGER) AS pos_end,
      nullif(f_n, '') AS name, TRY_CAST(f_sc AS INTEGER) AS score, nullif(f_st, '') AS strand FROM parsed WHERE reason IS NULL""",
    "p1_typed": f"""{_TYPED} SELECT line_id, source_file, plain AS contig, CAST(v_s + 1 AS INTEGER) AS pos_start, CAST(v_e AS INTEGER) AS pos_end,
      nullif(f_n, '') AS name, TRY_CAST(f_sc AS INTEGER) AS score, nullif(f_st, '') AS strand, {_INT.format("g_ts")} AS thick_start, {_INT.format("g_te")} AS thick_end, {_INT.format("g_bc")} AS block_count,
      {", ".join(f"CASE WHEN len(l_{n}) = len([x FOR x IN l_{n} IF x IS NOT NULL]) THEN l_{n} END AS {c}" for n, c in (("rgb", "item_rgb"), ("bs", "block_sizes"), ("bst", "block_starts")))} FROM lists""",
    "p1_reasons": f"{_PARSED} SELECT source_file, coalesce(reason, 'valid') AS verdict, count(*) AS n FROM parsed GROUP BY 1, 2",
    "p2_found": f"""{_PERIODS}, near AS (SELECT *, lag(pos_end) OVER (PARTITION BY sample_id, contig ORDER BY pos_start) AS before FROM period)
      SELECT 'period' AS kind, sample_id, contig, pos_start, pos_end FROM period
      UNION ALL SELECT 'gap', sample_id, contig, before + 1, pos_start - 1 FROM near WHERE pos_start - before - 1 BETWEEN 1 AND 10000""",
    "p2_covered": f"{_PERIODS} SELECT sample_id, contig, CAST(sum(pos_end - pos_start + 1) AS BIGINT) AS covered FROM period GROUP BY 1, 2",
    "p3_found": f"{_STATES} SELECT sample_id, contig FROM a WHERE sample_id IS NOT NULL AND contig IS NOT NULL AND nl * 100 >= 3 * (SELECT count(*) FROM alignment)",
    "p3_pairs": f"""{_STATES}, cov AS ({_PERIODS.replace("WITH spans", "WITH spans", 1)} SELECT sample_id, contig, sum(pos_end - pos_start + 1) AS covered FROM period GROUP BY 1, 2)
      SELECT j.sample_id, j.contig, nl AS n_left, coalesce(nr, 0) AS n_right, nl * coalesce(nr, 1) AS n_joined, CAST(sum_mapq * coalesce(nr, 1) AS BIGINT) AS sum_mapq, min_start, max_end,
        CAST(sum_coverage * nl AS BIGINT) AS sum_coverage, max_coverage, CAST(covered AS BIGINT) AS covered
      FROM j LEFT JOIN cov ON j.sample_id = cov.sample_id AND j.contig = cov.contig""",
    "p3_contigs": f"""{_STATES} SELECT contig, CAST(sum(nl) AS BIGINT) AS n_left, CAST(sum(coalesce(nr, 0)) AS BIGINT) AS n_right, CAST(sum(nl * coalesce(nr, 1)) AS BIGINT) AS n_joined,
      CAST(sum(sum_coverage * nl) AS BIGINT) AS sum_coverage FROM j GROUP BY 1""",
}
