"""Queries of the problems 4 to 8, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig
from spanlake.llm import packing, quantiles, runs, templates, tokenizer
from spanlake.plans.problems import PLAIN
from spanlake.tables import dealt, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_runs(table(spark, d, "coverage_block")).select("sample_id", "contig", "run_start", "run_end")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.coverage_runs(table(spark, d, "coverage_block"))


def _days(spark: SparkSession, d: str, name: str, value) -> DataFrame:
    return quantiles.build_sketches(table(spark, d, name), {"contig": plain_contig("contig"), "day": F.to_date("loaded_at")}, value)


def _mapq():
    """255 says that there is none."""
    return F.when(F.col("mapq") != 255, F.col("mapq"))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by contig, from the sketches of the days."""
    return quantiles.percentiles(quantiles.merge_sketches(_days(spark, d, "coverage_block", F.col("coverage")), ["contig"]))


def p5_coverage_days(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_days(spark, d, "coverage_block", F.col("coverage")))


def p5_mapq(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.merge_sketches(_days(spark, d, "alignment", _mapq()), ["contig"]))


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of ``p5_coverage`` lies within its stated error of the exact ranks, which are counted over all rows."""
    own = table(spark, d, "coverage_block").where("coverage IS NOT NULL").groupBy(plain_contig("contig").alias("contig"), F.col("coverage").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    told = p5_coverage(spark, d).withColumnRenamed("contig", "c")
    ranks = own.join(told, F.col("c").eqNullSafe(F.col("contig"))).groupBy("contig", "p").agg(
        F.sum(F.when(F.col("v") < F.col("value"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("m")).otherwise(0)).alias("upto"), F.sum("m").alias("n"), F.max("n").alias("counted"), F.max("rank_error").alias("e")
    )
    rank = F.ceil(F.col("p") * F.col("n"))
    slack = F.col("e") * (F.col("n") - rank) + 1
    return ranks.select("contig", "p", F.col("counted").alias("n"), ((F.col("below") - slack < rank) & (rank <= F.col("upto") + slack) & (F.col("n") == F.col("counted"))).alias("within"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(_documents(spark, d))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the decoded ids are the text again."""
    documents = _documents(spark, d).select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("own"))
    return documents.join(tokenizer.decode(p6_ids(spark, d)), "doc_id").select("doc_id", (F.col("own") == F.col("text")).alias("same"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_packed(spark, d))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """The documents, each whole and once; no container above the capacity; at most 1 % more containers than the tokens need."""
    packed = p7_packed(spark, d)
    by_document = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") == packing.CAPACITY).alias("full"))
    whole = (F.col("pieces") == 1) | (F.col("full") >= F.col("pieces") - 1)
    a = by_document.agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.bool_and(whole).alias("whole"))
    b = packing.containers(packed).agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("most"))
    return a.join(b, F.lit(True)).select("documents", "whole", (F.col("most") <= packing.CAPACITY).alias("fits"), (F.col("n") <= F.ceil(F.col("tokens") / packing.CAPACITY) * 1.01 + 1).alias("tight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.residue(_documents(spark, d)).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return templates.judge(_documents(spark, d)).groupBy(F.coalesce("kind", F.lit("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p5_coverage, p5_coverage_days, p5_mapq, p5_within, p6_ids, p6_roundtrip, p7_packed, p7_containers, p7_sound, p8_found, p8_kinds)}

_RUNS = f"""WITH b AS (SELECT DISTINCT sample_id, {PLAIN.format("contig")} AS contig, pos_start AS s, pos_end AS e, coverage AS c FROM coverage_block
  WHERE sample_id IS NOT NULL AND contig IS NOT NULL AND pos_start IS NOT NULL AND pos_end IS NOT NULL),
 l AS (SELECT *, CASE WHEN s = lag(e) OVER w + 1 AND abs(c - lag(c) OVER w) <= 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY sample_id, contig ORDER BY s, e, c NULLS FIRST)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY sample_id, contig ORDER BY s, e, c NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM l),
 runs AS (SELECT sample_id, contig, min(s) AS run_start, arg_max(e, s) AS run_end, count(*) AS n_blocks, CAST(sum(e - s + 1) AS BIGINT) AS bases, min(c) AS min_cov, max(c) AS max_cov FROM r GROUP BY sample_id, contig, run)
"""
ORACLE = {
    "p4_found": f"{_RUNS} SELECT sample_id, contig, run_start, run_end FROM runs WHERE n_blocks >= 2",
    "p4_runs": f"{_RUNS} SELECT * FROM runs",
    "p5_within": f"SELECT contig, p, n, true AS within FROM (SELECT {PLAIN.format('contig')} AS contig, count(coverage) AS n FROM coverage_block GROUP BY 1 HAVING count(coverage) > 0), (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in quantiles.PERCENTILES)}]) AS p)",
    "p7_sound": "SELECT count(DISTINCT doc_id) AS documents, true AS whole, true AS fits, true AS tight FROM documents",
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
