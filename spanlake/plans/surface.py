"""Queries of readers, writers, converters, SQL functions, table functions and ordered look-ups, and the same in SQL.

Readers are tested by what the library's own writers, or Spark's text writer, put into the shared folder: the SQL is over
the table that was written. The whole table is written and read each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.converters import pileups as conv
from spanlake.functions import quality
from spanlake.functions.alignment import aligned_blocks
from spanlake.functions.contigs import plain_contig
from spanlake.operators import coverage as cov
from spanlake.operators import ordered
from spanlake.operators.intervals import feature_counts, interval_join
from spanlake.operators.pileup import pileup
from spanlake.plans.intervals import _BLOCKS, _MARKED, _R, READS, TARGETS, _T, marked_reads, reads, targets
from spanlake.plans.problems import PLAIN
from spanlake.session import Session
from spanlake.sinks.tables import save_by_sample, write_pileup, write_report
from spanlake.sources import register, text
from spanlake.sources.bai import write_indexes
from spanlake.sources.bam import samples
from spanlake.sources.files import plain
from spanlake.tables import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


def _lines(df: DataFrame, spark: SparkSession, name: str) -> str:
    """The one text column of ``df`` as files, whose rows may hold several lines."""
    df.write.text(folder := scratch(spark, name))
    return f"{folder}/*.txt"


# BAM ---------------------------------------------------------------------------------------------------------------


def _written_bam(spark: SparkSession, d: str, in_order: bool = False) -> str:
    register(spark)
    lengths = table(spark, d, "contig_list").select(F.concat(F.lit("chr"), F.when(F.col("contig") == "MT", "M").otherwise(F.col("contig"))).alias("c"), "n_bases").collect()  # a genome's contigs
    rows = table(spark, d, "alignment").withColumnsRenamed({"tag_as": "tag_AS", "tag_nm": "tag_NM", "tag_rg": "tag_RG"}).withColumn("contig", F.concat(F.lit("chr"), F.when(plain_contig("contig") == "MT", "M").otherwise(plain_contig("contig"))))
    if in_order:
        rows = rows.where("contig IS NOT NULL AND pos_start > 0").repartitionByRange("contig", "pos_start").sortWithinPartitions("contig", "pos_start")
    folder = scratch(spark, "bam")
    rows.write.format("bam").mode("append").option("contigs", ",".join(f"{r.c}:{r.n_bases}" for r in lengths)).option("sample", "S1").save(folder)
    return folder


_OWN = f"""WITH a AS (SELECT CASE WHEN {PLAIN.format("contig")} IN (SELECT contig FROM contig_list) THEN {PLAIN.format("contig")} END AS contig, coalesce(qname, '*') AS qname, coalesce(flag, 0) AS flag, coalesce(pos_start, 0) AS pos_start,
  coalesce(mapq, 255) AS mapq, coalesce(nullif(cigar, ''), '*') AS cigar, coalesce(nullif(seq, ''), '*') AS seq, tag_as, tag_nm, tag_rg FROM alignment)"""


@_add("src_bam", f"{_OWN} SELECT * FROM a")
def src_bam(spark, d):
    rows = spark.read.format("bam").option("splitSize", "100000").load(_written_bam(spark, d))
    return rows.select("contig", "qname", "flag", "pos_start", "mapq", "cigar", "seq", F.col("tag_AS").alias("tag_as"), F.col("tag_NM").alias("tag_nm"), F.col("tag_RG").alias("tag_rg"))


@_add("src_bam_index", f"{_OWN} SELECT contig, qname, flag, pos_start FROM a WHERE contig IN ('1', 'X') AND pos_start BETWEEN 1 AND 90000000")
def src_bam_index(spark, d):
    folder = _written_bam(spark, d, True)
    write_indexes(spark, folder)
    return spark.read.format("bam").load(folder).where("contig IN ('1', 'X') AND pos_start >= 1 AND pos_start <= 90000000").select("contig", "qname", "flag", "pos_start")


@_add("src_bam_sample", "SELECT count(*) AS n, 'S1' AS sample_id FROM alignment")
def src_bam_sample(spark, d):
    """By table and sample, through DDL; the name of the sample comes from the files alone."""
    folder = _written_bam(spark, d)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW spanlake_written USING bam OPTIONS (path '{folder}')")
    found = Session(spark).reads("spanlake_written", "S1").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("sample_id", F.lit(",".join(samples(folder))))


# text formats ------------------------------------------------------------------------------------------------------


@_add("src_fastq", """SELECT 'M' || p_size AS instrument_name, CAST(p_partkey % 1000 AS INTEGER) AS run_id, 'F' || p_partkey AS flowcell_id, CAST(p_size AS INTEGER) AS lane, CAST(p_partkey AS INTEGER) AS pos_x,
  p_partkey % 2 = 0 AS filter_passed, 'ACGT' AS index_seq, repeat('ACGTN', p_size) AS seq, repeat('I@I+I', p_size) AS qual FROM part""")
def src_fastq(spark, d):
    register(spark)
    name = "'@M', p_size, ':', p_partkey % 1000, ':F', p_partkey, ':', p_size, ':7:', p_partkey, ':9 1:', if(p_partkey % 2 = 0, 'N', 'Y'), ':18:ACGT'"
    lines = table(spark, d, "part").selectExpr(f"concat({name}, '\\n', repeat('ACGTN', p_size), '\\n+\\n', repeat('I@I+I', p_size), if(p_partkey % 3 = 0, '\\n', '')) AS value")
    return spark.read.format("fastq").option("splitSize", "20000").load(_lines(lines, spark, "fastq")).select("instrument_name", "run_id", "flowcell_id", "lane", "pos_x", "filter_passed", "index_seq", "seq", "qual")


@_add("src_fasta", "SELECT CAST(p_partkey AS VARCHAR) AS contig, CAST(1 AS INTEGER) AS chunk_start, upper(repeat('acgtn', p_size)) AS bases FROM part")
def src_fasta(spark, d):
    register(spark)
    lines = table(spark, d, "part").selectExpr("concat('>chr', p_partkey, ' some words\\n', substring(repeat('acgtn', p_size), 1, 3 * p_size), '\\n', substring(repeat('acgtn', p_size), 1 + 3 * p_size)) AS value")
    return spark.read.format("fasta").load(_lines(lines, spark, "fasta"))


@_add("src_bed", f"""SELECT {PLAIN.format("contig")} AS contig, pos_start, pos_end, coalesce(name, '') AS name, score, coalesce(strand, '') AS strand, thick_start, thick_end, CASE WHEN len(item_rgb) > 0 THEN item_rgb END AS item_rgb, block_count,
  CASE WHEN len(block_sizes) > 0 THEN block_sizes END AS block_sizes, CASE WHEN len(block_starts) > 0 THEN block_starts END AS block_starts FROM bed_feature""")
def src_bed(spark, d):
    fields = ("contig", "pos_start - 1", "pos_end", "name", "score", "strand", "thick_start", "thick_end", "array_join(item_rgb, ',')", "block_count", "array_join(block_sizes, ',')", "array_join(block_starts, ',')")
    lines = table(spark, d, "bed_feature").selectExpr("concat_ws('\\t', " + ", ".join(f"coalesce(CAST({f} AS STRING), '')" for f in fields) + ") AS value")
    return text.bed(spark, _lines(lines.union(spark.sql("SELECT 'track name=x' UNION ALL SELECT 'Browser y'")), spark, "bed"))


_VCF = "concat('chr', p_partkey % 5, '\\t', p_partkey, '\\t', if(p_size % 2 = 0, 'rs1;rs2', '.'), '\\tGT\\tG,GTT\\t', p_size, '\\tPASS\\tDP=', p_size, ';DB;DP=9', if(p_size % 3 = 0, ';END=' || (p_partkey + 40), ''), '\\tGT:GQ\\t0|1:', p_size, '\\t1|1') AS value"
_VCF_SQL = """SELECT CAST(p_partkey % 5 AS VARCHAR) AS contig, CAST(p_partkey - 1 AS INTEGER) AS pos_start, CAST(CASE WHEN p_size % 3 = 0 THEN p_partkey + 40 ELSE p_partkey + 1 END AS INTEGER) AS pos_end, CASE WHEN p_size % 2 = 0 THEN 'rs1,rs2' ELSE '' END AS names,
  'GT' AS ref, {0} AS alt, CAST(p_size AS DOUBLE) AS qual, CAST(p_size AS VARCHAR) AS dp, '0|1,1|1' AS gt, CAST(p_size AS VARCHAR) AS gq FROM part"""


def _vcf(split: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        rows = text.vcf(spark, _lines(table(spark, d, "part").selectExpr(_VCF).union(spark.sql("SELECT '##fileformat=VCFv4.2\\n#CHROM'")), spark, "vcf"), split_alleles=split)
        return rows.select("contig", "pos_start", "pos_end", F.array_join("names", ",").alias("names"), "ref", F.array_join("alt", ",").alias("alt"), "qual", F.col("info")["DP"].alias("dp"), F.array_join(F.transform("genotypes", lambda g: g["GT"]), ",").alias("gt"), F.col("genotypes")[0]["GQ"].alias("gq"))

    return run


_add("src_vcf", _VCF_SQL.format("'G,GTT'"))(_vcf(False))
_add("src_vcf_split", _VCF_SQL.format("unnest(['G', 'GTT'])"))(_vcf(True))


@_add("src_vcf_normalized", """SELECT CAST(p_partkey AS VARCHAR) AS contig, CAST(1 AS INTEGER) AS pos_start, CAST(4 AS INTEGER) AS pos_end, 'TCA' AS ref, 'T' AS alt FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(2 * p_size + 3 AS INTEGER), CAST(2 * p_size + 4 AS INTEGER), 'T', 'G' FROM part""")
def src_vcf_normalized(spark, d):
    """Each part is a contig of GT, a run of CA, and TT; one variant takes the last CA of the run away, one is written with more bases than it needs."""
    register(spark)
    part = table(spark, d, "part")
    reference = spark.read.format("fasta").load(_lines(part.selectExpr("concat('>', p_partkey, '\\nGT', repeat('CA', p_size), 'TT') AS value"), spark, "fasta"))
    head = "concat('chr', p_partkey, '\\t', {0}, '\\t.\\t', {1}, '\\t', {2}, '\\t.\\t.\\t.')"
    lines = part.selectExpr(f"stack(2, {head.format('2 * p_size', chr(39).join(['if(p_size = 1, ', 'TCA', ', ', 'ACA', ')']), chr(39).join(['if(p_size = 1, ', 'T', ', ', 'A', ')']))}, {head.format('2 * p_size + 1', chr(39) + 'CATT' + chr(39), chr(39) + 'CATG' + chr(39))}) AS value")
    return text.vcf(spark, _lines(lines, spark, "vcf"), reference=reference).select("contig", "pos_start", "pos_end", "ref", F.col("alt")[0].alias("alt"))


@_add("src_adam", f"SELECT contig, pos_start, pos_end, name FROM ({TARGETS})")
def src_adam(spark, d):
    targets(spark, d).withColumnsRenamed({"contig": "contigName", "pos_start": "start", "pos_end": "end"}).write.parquet(folder := scratch(spark, "adam"))
    return text.parquet_alignments(spark, folder)


@_add("src_targets", f"SELECT contig AS \"Chr\", CAST(pos_start AS VARCHAR) AS \"Start\", CAST(pos_end AS VARCHAR) AS \"End\", name AS \"GeneID\" FROM ({TARGETS})")
def src_targets(spark, d):
    targets(spark, d).select(F.col("name").alias("GeneID"), F.col("contig").alias("Chr"), F.col("pos_start").alias("Start"), F.col("pos_end").alias("End")).write.option("header", "true").option("delimiter", "\t").csv(folder := scratch(spark, "targets"))
    return text.targets(spark, folder)


# pileup texts and their conversion ---------------------------------------------------------------------------------

#: Two positions for each part: at the first a read begins, one ends, two differ, one has an insertion and one a deletion of a base, which the second shows.
_MPILEUP = "stack(2, concat('chr1\\t', p_partkey * 10, '\\tg\\t', p_size + 3, '\\t^~.', repeat(',', p_size - 1), '$A+2GTc,-1n.\\t', repeat('I', p_size + 4)), concat('chr1\\t', p_partkey * 10 + 1, '\\tT\\t3\\t.,*\\t+!I')) AS value"
_MPILEUP_SQL = """SELECT '1' AS contig, CAST(p_partkey * 10 AS INTEGER) AS pos_start, CAST(p_partkey * 10 AS INTEGER) AS pos_end, 'G' AS ref, CAST(p_size + 3 AS INTEGER) AS coverage, '(A,1)(c,1)' AS alts, '(A,(I,1))(G,(I,' || (p_size + 2) || '))(c,(I,1))' AS quals FROM part
  UNION ALL SELECT '1', CAST(p_partkey * 10 + 1 AS INTEGER), CAST(p_partkey * 10 + 1 AS INTEGER), 'T', 2, NULL, NULL FROM part"""


@_add("conv_mpileup", _MPILEUP_SQL)
def conv_mpileup(spark, d):
    return conv.maps_to_strings(conv.from_mpileup(text.mpileup(spark, _lines(table(spark, d, "part").selectExpr(_MPILEUP), spark, "mpileup"))))


@_add("conv_spaced", "SELECT '1' AS contig, CAST(p_partkey AS INTEGER) AS pos_start, CAST(p_partkey AS INTEGER) AS pos_end, 'T' AS ref, CAST(p_size + 2 AS INTEGER) AS coverage, '(A,' || p_size || ')(g,2)' AS alts, CAST(NULL AS VARCHAR) AS quals FROM part")
def conv_spaced(spark, d):
    lines = table(spark, d, "part").selectExpr("concat('chr1 ', p_partkey, ' t ', repeat('A', p_size), 'gg III') AS value")
    return conv.maps_to_strings(conv.from_spaced_pileup(text.spaced_pileup(spark, _lines(lines, spark, "spaced"))))


def _typed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"alts": F.lit(None).cast("map<string,int>"), "quals": F.lit(None).cast("map<string,map<string,int>>")})


@_add("conv_blocks_to_bases", f"{_BLOCKS} SELECT contig, CAST(p AS INTEGER) AS pos_start, CAST(p AS INTEGER) AS pos_end, ref, coverage FROM (SELECT *, unnest(generate_series(pos_start, pos_end)) AS p FROM blocks)")
def conv_blocks_to_bases(spark, d):
    return conv.blocks_to_bases(_typed(cov.coverage(reads(spark, d)))).drop("alts", "quals")


@_add("conv_bases_to_blocks", f"{_BLOCKS} SELECT contig, pos_start, pos_end, repeat('R', pos_end - pos_start + 1) AS ref, coverage FROM blocks")
def conv_bases_to_blocks(spark, d):
    return conv.bases_to_blocks(_typed(cov.per_base(cov.coverage(reads(spark, d))))).drop("alts", "quals")


@_add("conv_compare", "SELECT * FROM (VALUES ('blocks', 'again', true), ('blocks', 'less', false), ('again', 'less', false)) t(first, second, equal)")
def conv_compare(spark, d):
    blocks = cov.coverage(reads(spark, d))
    got = conv.compare_all({"blocks": blocks, "again": blocks, "less": blocks.where("coverage > 1")})
    return spark.createDataFrame([(a, b, e) for (a, b), e in got.items()], "first string, second string, equal boolean")


# writers -----------------------------------------------------------------------------------------------------------

_PILEUP_SQL = f"{_MARKED} FROM bl LEFT JOIN am ON bl.contig = am.contig AND bl.pos_start = am.p WHERE coverage > 0 AND pos_end IS NOT NULL"


@_add("sink_pileup_text", f"SELECT contig, pos_start, pos_end, ref, coverage, alts FROM ({_PILEUP_SQL})")
def sink_pileup_text(spark, d):
    rows = pileup(marked_reads(spark, d)).select("contig", "pos_start", "pos_end", "ref", "coverage", quality.altmap_to_str("alts").alias("alts"), F.lit(None).cast("string").alias("quals"))
    write_pileup(rows, folder := scratch(spark, "pileup"))
    return text.block_pileup(spark, folder).drop("quals")


def _report(rows: Callable[[SparkSession, str], DataFrame], order: list[str], types: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        write_report(rows(spark, d), folder := scratch(spark, "report"), order)
        return spark.read.option("header", "true").option("delimiter", "\t").schema(types).csv(folder)

    return run


_add("sink_depth_report", f"{_BLOCKS} SELECT contig, pos_start, pos_end, ref, coverage FROM blocks")(_report(lambda s, d: cov.coverage(reads(s, d)), ["contig", "pos_start"], "contig string, pos_start int, pos_end int, ref string, coverage int"))
_add("sink_counts_report", f"{_R} SELECT t.contig, t.pos_start, t.pos_end, name, count(*) AS n_reads, t.pos_end - t.pos_start + 1 AS length FROM r JOIN t ON r.contig = t.contig AND {_T} GROUP BY ALL")(
    _report(lambda s, d: feature_counts(reads(s, d), targets(s, d)), ["name"], "contig string, pos_start int, pos_end int, name string, n_reads bigint, length int")
)


@_add("sink_orc", f"{_BLOCKS} SELECT contig, pos_start, pos_end, coverage FROM blocks")
def sink_orc(spark, d):
    """Through Parquet and ORC."""
    cov.coverage(reads(spark, d)).write.parquet(one := scratch(spark, "parquet"))
    spark.read.parquet(one).write.orc(two := scratch(spark, "orc"))
    return spark.read.orc(two).drop("ref")


@_add("sink_by_sample", f"SELECT contig, pos_start, sample_id FROM ({READS}) WHERE sample_id <> 'O' UNION ALL SELECT contig, pos_start + 1000, sample_id FROM ({READS}) WHERE sample_id = 'O'")
def sink_by_sample(spark, d):
    r = reads(spark, d).select("contig", "pos_start", "sample_id")
    save_by_sample(r, folder := scratch(spark, "samples"))
    save_by_sample(r.where("sample_id = 'O'").withColumn("pos_start", F.col("pos_start") + 1000), folder, overwrite_samples=True)
    return spark.read.parquet(folder)


@_add("sql_ctas_by_sample", f"SELECT contig, pos_start, sample_id FROM ({READS}) UNION ALL SELECT contig, pos_start, sample_id FROM ({READS}) WHERE sample_id = 'O'")
def sql_ctas_by_sample(spark, d):
    """CREATE TABLE AS, INSERT INTO and INSERT OVERWRITE of one sample."""
    reads(spark, d).select("contig", "pos_start", "sample_id").createOrReplaceTempView("spanlake_reads")
    folder, name = scratch(spark, "ctas"), "spanlake_by_sample"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet PARTITIONED BY (sample_id) LOCATION '{folder}' AS SELECT contig, pos_start + 5 AS pos_start, sample_id FROM spanlake_reads")
    for sample in ("O", "F"):
        spark.sql(f"INSERT OVERWRITE {name} PARTITION (sample_id = '{sample}') SELECT contig, pos_start FROM spanlake_reads WHERE sample_id = '{sample}'")
    spark.sql(f"INSERT INTO {name} PARTITION (sample_id = 'O') SELECT contig, pos_start FROM spanlake_reads WHERE sample_id = 'O'")
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(folder)


@_add("src_table_paths", f"SELECT DISTINCT sample_id, true AS own, true AS located FROM ({READS})")
def src_table_paths(spark, d):
    """The samples of a table by its files, and that its folder is the declared one."""
    save_by_sample(reads(spark, d).select("contig", "pos_start", "sample_id"), folder := scratch(spark, "paths"))
    session, name = Session(spark), "spanlake_paths"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (contig STRING, pos_start INT, sample_id STRING) USING parquet PARTITIONED BY (sample_id) LOCATION '{folder}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    located = plain(session.location(name)).rstrip("/") == plain(folder).rstrip("/")
    found = [(s, bool(own := session.files(name, s)) and all(f"sample_id={s}" in f for f in own), located) for s in session.samples(name)]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(found, "sample_id string, own boolean, located boolean")


# functions ---------------------------------------------------------------------------------------------------------


def _sql(query: str, views: dict[str, Callable[[SparkSession, str], DataFrame]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        session = Session(spark)
        for name, of in views.items():
            of(spark, d).createOrReplaceTempView(name)
        return session.sql(query)

    return run


def _of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


_CALLS = {"shift": "5", "resize": "5, 'center'", "flank": "-5, true, false", "promoters": "100, 20", "reflect": "11000, 15000"}
_add("sql_intervals", f"""WITH t AS (SELECT pos_start AS s, pos_end AS e FROM ({TARGETS})) SELECT s, e, s + 5 AS shift_start, e + 5 AS shift_end, s - 3 AS resize_start, CAST(s + 2 * ((e - s) // 2) + 2 AS INTEGER) AS resize_end,
  s AS flank_start, s + 4 AS flank_end, s - 100 AS promoters_start, s + 19 AS promoters_end, 26000 - e AS reflect_start, 26000 - s AS reflect_end, least(e, 900) - greatest(s, 500) + 1 AS shared FROM t""")(
    _sql("SELECT s, e, " + ", ".join(f"bdg_{f}(s, e, {a}).{x} AS {f}_{x}" for f, a in _CALLS.items() for x in ("start", "end")) + ", bdg_overlaplength(s, e, 500, 900) AS shared FROM spanlake_t", {"spanlake_t": lambda s, d: targets(s, d).selectExpr("pos_start AS s", "pos_end AS e")})
)
_add("sql_qualities", """SELECT CAST(p_size AS INTEGER) AS n, '(A,' || p_size || ')(c,2)' AS alts, '(A,(",2)' || CASE WHEN p_size % 3 > 0 THEN '(#,' || p_size % 3 || ')' ELSE '' END || ')(c,(!,1))' AS quals, CAST(3 + p_size % 3 AS INTEGER) AS cov, CAST(p_size AS INTEGER) AS cov_null,
  p_size = 7 AS equal, '(A,(",1))' AS chars, '(A,(I,2))' AS bytes FROM part""")(
    _sql("""SELECT n, altmap_to_str(alts_to_char(map(65, n, 99, 2))) AS alts, qualsmap_to_str(quals_to_map(q)) AS quals, quals_to_cov(q, n) AS cov, quals_to_cov(CAST(NULL AS MAP<STRING, ARRAY<INT>>), n) AS cov_null, cov_equals(n, 7) AS equal,
      qualsmap_to_str(to_charmap(map(65, array(0, 1)))) AS chars, qualsmap_to_str(quals_to_char(map(65, map('I', 2)))) AS bytes FROM spanlake_q""", {"spanlake_q": lambda s, d: table(s, d, "part").selectExpr("CAST(p_size AS INT) AS n", "map('c', array(1, 0, 0), 'A', array(0, 2, CAST(p_size % 3 AS INT))) AS q")})
)


@_add("fn_qualities", "SELECT CAST(p_size AS INTEGER) AS n, '(A,' || p_size || ')(c,2)' AS alts, '(A,(!,' || p_size || '))' AS quals, CAST(p_size + 2 AS INTEGER) AS total, CAST(p_size AS INTEGER) AS cov, '(A,(!,' || p_size || '))' AS chars FROM part")
def fn_qualities(spark, d):
    n = F.col("n")
    q, b = F.create_map(F.lit("A"), F.array(n)), F.create_map(F.lit(65), n, F.lit(99), F.lit(2))
    strings = {"alts": quality.altmap_to_str(quality.alts_to_char(b)), "quals": quality.qualsmap_to_str(quality.quals_to_map(q)), "total": quality.alt_total(b), "cov": quality.quals_to_cov(q, "n"), "chars": quality.qualsmap_to_str(quality.to_charmap(F.create_map(F.lit(65), F.array(n))))}
    return table(spark, d, "part").select(F.col("p_size").cast("int").alias("n")).withColumns(strings)


_CIGAR_SQL = """WITH ids AS (SELECT row_number() OVER () AS rid, pos_start, cigar FROM alignment WHERE pos_start IS NOT NULL AND cigar IS NOT NULL),
  o AS (SELECT rid, pos_start, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS i, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS op FROM ids),
  q AS (SELECT *, CAST(left(op, length(op) - 1) AS INTEGER) AS n, right(op, 1) AS k FROM o),
  z AS (SELECT *, coalesce(sum(CASE WHEN k IN ('M', '=', 'X', 'N', 'D') THEN n ELSE 0 END) OVER w, 0) AS here, coalesce(sum(CASE WHEN k IN ('M', '=', 'X', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS idx,
    coalesce(sum(CASE WHEN k IN ('M', '=', 'X', 'D') THEN n ELSE 0 END) OVER w, 0) AS md FROM q WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT CAST(pos_start + here AS INTEGER) AS s, CAST(pos_start + here + n - 1 AS INTEGER) AS e, CAST(idx AS INTEGER) AS i, CAST(md AS INTEGER) AS m, count(*) AS reads FROM z WHERE k IN ('M', '=', 'X') GROUP BY ALL"""


@_add("fn_cigar", _CIGAR_SQL)
def fn_cigar(spark, d):
    rows = table(spark, d, "alignment").where("pos_start IS NOT NULL AND cigar IS NOT NULL").select(F.explode(aligned_blocks("pos_start", "cigar")).alias("_b"))
    return rows.groupBy("_b.s", "_b.e", "_b.i", "_b.m").agg(F.count(F.lit(1)).alias("reads"))


# pileups of reads with clips, insertions, deletions and skips, and lower-case tags ----------------------------------

_WOVEN = f"""WITH r AS (SELECT contig, pos_start AS s, pos_end - pos_start + 1 AS q, CASE sample_id WHEN 'O' THEN 'a' ELSE 'A' END AS base FROM ({READS}) WHERE pos_start < pos_end),
  sp AS (SELECT contig, s, s + q + 1 AS e FROM r UNION ALL SELECT contig, s + q + 5, s + q + 6 FROM r UNION ALL SELECT contig, s + q + 12, s + q + 13 FROM r),
  alt AS (SELECT contig, p, base, ref, count(*) AS n FROM (SELECT contig, s + q AS p, base, 'C' AS ref FROM r UNION ALL SELECT contig, s + q + 13, base, 'G' FROM r) GROUP BY ALL),
  ev AS (SELECT contig, s AS p, 1 AS d, 0 AS k FROM sp UNION ALL SELECT contig, e + 1, -1, 0 FROM sp UNION ALL SELECT contig, p, 0, 1 FROM alt UNION ALL SELECT contig, p + 1, 0, 1 FROM alt),
  pt AS (SELECT contig, p, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0 OR max(k) = 1),
  bl AS (SELECT contig, p AS pos_start, CAST(lead(p) OVER w - 1 AS INTEGER) AS pos_end, CAST(sum(d) OVER w AS INTEGER) AS coverage FROM pt WINDOW w AS (PARTITION BY contig ORDER BY p)),
  ab AS (SELECT contig, p, base, sum(n) AS n FROM alt GROUP BY ALL),
  am AS (SELECT contig, p, string_agg('(' || base || ',' || CAST(n AS BIGINT) || ')', '' ORDER BY base) AS alts, CAST(sum(n) AS INTEGER) AS n FROM ab GROUP BY ALL), rf AS (SELECT contig, p, max(ref) AS ref FROM alt GROUP BY ALL)
  SELECT bl.contig, CAST(pos_start AS INTEGER) AS pos_start, pos_end, coalesce(rf.ref, 'R') AS ref, coverage, CAST(coverage - coalesce(n, 0) AS INTEGER) AS countRef, coalesce(n, 0) AS countNonRef, alts
  FROM bl LEFT JOIN am ON bl.contig = am.contig AND bl.pos_start = am.p LEFT JOIN rf ON bl.contig = rf.contig AND bl.pos_start = rf.p WHERE coverage > 0 AND pos_end IS NOT NULL"""


def woven_reads(spark, d):
    q = (F.col("pos_end") - F.col("pos_start") + 1).cast("int")
    return reads(spark, d).where("pos_start < pos_end").select(
        "contig", "pos_start", (F.col("pos_end") + 13).cast("int").alias("pos_end"), F.concat(F.lit("2S"), q, F.lit("M1I2M3D2M5N2M")).alias("cigar"), F.concat(q, F.lit("c1^TTT3g0")).alias("tag_md"),
        F.concat(F.lit("NN"), F.repeat(F.lit("A"), q), F.lit("GAAAAAA")).alias("seq"), F.repeat(F.char(F.col("n") + 33), q + 9).alias("qual"), F.when(F.col("sample_id") == "O", 16).otherwise(0).alias("flag"),
    )


@_add("pileup_woven", _WOVEN)
def pileup_woven(spark, d):
    return pileup(woven_reads(spark, d)).drop("quals").withColumn("alts", quality.altmap_to_str("alts"))


@_add("pileup_bins", f"""WITH r AS (SELECT contig, pos_start, pos_end, n, CASE sample_id WHEN 'O' THEN 'a' ELSE 'A' END AS base FROM ({READS}) WHERE pos_start < pos_end),
  alt AS (SELECT DISTINCT contig, CAST(pos_start + least(n, pos_end - pos_start) AS INTEGER) AS p FROM r)
  SELECT r.contig, p AS pos_start, base, CAST(n // 3 AS INTEGER) AS bin, CAST(count(*) AS INTEGER) AS reads FROM r JOIN alt ON r.contig = alt.contig AND p BETWEEN r.pos_start AND r.pos_end GROUP BY ALL""")
def pileup_bins(spark, d):
    by_base = pileup(marked_reads(spark, d), quals=True, bin_size=3).select("contig", "pos_start", F.explode("quals").alias("base", "counts"))
    return by_base.select("contig", "pos_start", "base", F.posexplode("counts").alias("bin", "reads")).where("reads > 0")


# SQL: table functions and overlap joins -----------------------------------------------------------------------------

_VIEWS = {"spanlake_r": reads, "spanlake_t": targets}
_SHARED = "CAST(sum(least(r.pos_end, t.pos_end) - greatest(r.pos_start, t.pos_start) + 1) AS BIGINT) AS shared"
for _name, _condition in (("sql_overlap_join", f"r.contig = t.contig AND {_T}"), ("sql_overlap_noeq", _T), ("sql_overlap_cast", f"CAST(r.pos_end AS INTEGER) >= t.pos_start AND r.contig = t.contig AND t.pos_end >= CAST(r.pos_start AS BIGINT)")):
    _select = "SELECT t.contig AS t_contig, t.pos_start AS t_start, t.pos_end AS t_end, name, count(*) AS n, " + _SHARED
    _group = "GROUP BY t.contig, t.pos_start, t.pos_end, name"
    _add(_name, f"{_R} {_select} FROM r JOIN t ON {_condition} {_group}")(_sql(f"{_select} FROM spanlake_r r JOIN spanlake_t t ON {_condition} {_group}", _VIEWS))


def _with(setting: str, value: str, query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        spark.conf.set(f"spanlake.{setting}", value)
        try:
            return _sql(query, _VIEWS)(spark, d)
        finally:
            spark.conf.unset(f"spanlake.{setting}")

    return run


for _name, _setting, _value, _condition in (
    ("sql_min_overlap", "minOverlap", "10", f"{_T} AND least(r.pos_end, t.pos_end) - greatest(r.pos_start, t.pos_start) + 1 >= 10"),
    ("sql_max_gap", "maxGap", "20", "r.pos_end + 20 >= t.pos_start AND r.pos_start - 20 <= t.pos_end"),
    ("sql_join_order", "useJoinOrder", "true", _T),
):
    _add(_name, f"{_R} {_select} FROM r JOIN t ON r.contig = t.contig AND {_condition} {_group}")(_with(_setting, _value, f"{_select} FROM spanlake_r r JOIN spanlake_t t ON r.contig = t.contig AND {_T} {_group}"))
_add("sql_grange", f"{_R} SELECT r.* FROM r WHERE r.contig = '1' AND r.pos_end >= 101 AND r.pos_start <= 140")(_sql("SELECT r.* FROM spanlake_r r JOIN bdg_grange('1', 101, 140) AS g(c, s, e) ON r.contig = g.c AND r.pos_end >= g.s AND r.pos_start <= g.e", _VIEWS))
_add("sql_range", "SELECT range AS id FROM range(10) UNION ALL SELECT range FROM range(3, 9, 2)")(_sql("SELECT id FROM range(10) UNION ALL SELECT x FROM range(3, 9, 2) AS t(x)", {}))
for _name, _form, _query in (
    ("sql_coverage", "", f"{_BLOCKS} SELECT * FROM blocks WHERE coverage > 1"),
    ("sql_coverage_bases", ", 'bases'", f"{_BLOCKS} SELECT contig, CAST(p AS INTEGER) AS pos_start, CAST(p AS INTEGER) AS pos_end, ref, coverage FROM (SELECT *, unnest(generate_series(pos_start, pos_end)) AS p FROM blocks) WHERE coverage > 1"),
    ("sql_coverage_windows", ", 100", f"""{_BLOCKS} SELECT * FROM (SELECT contig, CAST(w * 100 + 1 AS INTEGER) AS pos_start, CAST(w * 100 + 100 AS INTEGER) AS pos_end, CAST(sum(coverage) AS DOUBLE) / 100 AS coverage
      FROM (SELECT contig, coverage, CAST(floor((unnest(generate_series(pos_start, pos_end)) - 1) / 100.0) AS BIGINT) AS w FROM blocks) GROUP BY contig, w) WHERE coverage > 1"""),
):
    _add(_name, _query)(_sql(f"SELECT * FROM coverage('spanlake_s', 'S', ''{_form}) c WHERE c.coverage > 1", {"spanlake_s": lambda s, d: reads(s, d).withColumn("sample_id", F.lit("S"))}))
_add("sql_pileup", f"SELECT contig, count(*) AS n, CAST(sum(countNonRef) AS BIGINT) AS other FROM ({_PILEUP_SQL}) GROUP BY contig")(
    _sql("SELECT contig, count(*) AS n, sum(countNonRef) AS other FROM pileup('spanlake_m', 'S', '', true, false) GROUP BY contig", {"spanlake_m": lambda s, d: marked_reads(s, d).withColumn("sample_id", F.lit("S"))})
)

# SQL that Spark brings ------------------------------------------------------------------------------------------------

_PIVOT = ", ".join(f"count(CASE WHEN l_linestatus = '{s}' THEN 1 END) AS {s}" for s in ("O", "F"))
for _name, _ours, _query, _tables in (
    ("sql_limit", None, "SELECT sample_id, qname, pos_start, flag, tag_nm FROM alignment WHERE pos_start IS NOT NULL ORDER BY pos_start DESC, qname, flag, sample_id, tag_nm LIMIT 50", ("alignment",)),
    ("sql_order", None, "SELECT name, rank FROM (SELECT name, CAST(row_number() OVER (ORDER BY pos_start, pos_end, name) AS BIGINT) AS rank FROM bed_feature) t ORDER BY rank", ("bed_feature",)),
    ("sql_grouping_sets", None, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", ("lineitem",)),
    ("sql_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS O, 'F' AS F))", f"SELECT l_returnflag, {_PIVOT.replace('count', 'nullif(count').replace('END)', 'END), 0)')} FROM lineitem GROUP BY 1", ("lineitem",)),
    ("sql_unpivot", "SELECT name, place, position FROM bed_feature UNPIVOT (position FOR place IN (pos_start, pos_end))", "SELECT name, 'pos_start' AS place, pos_start AS position FROM bed_feature WHERE pos_start IS NOT NULL UNION ALL SELECT name, 'pos_end', pos_end FROM bed_feature WHERE pos_end IS NOT NULL", ("bed_feature",)),
    ("sql_cte", "WITH c AS (SELECT contig, pos_end - pos_start + 1 AS size, size * 2 AS twice FROM bed_feature) SELECT contig, max(size) AS size, max(twice) AS twice FROM c WHERE size > (SELECT avg(pos_end - pos_start) FROM bed_feature) GROUP BY contig",
     "WITH c AS (SELECT contig, pos_end - pos_start + 1 AS size, (pos_end - pos_start + 1) * 2 AS twice FROM bed_feature) SELECT contig, max(size) AS size, max(twice) AS twice FROM c WHERE size > (SELECT avg(pos_end - pos_start) FROM bed_feature) GROUP BY contig", ("bed_feature",)),
):
    _add(_name, _query)(_sql(_ours or _query, {t: _of(t) for t in _tables}))

# joins that the first set has not -------------------------------------------------------------------------------------

_NEAR = f"WITH t AS ({TARGETS}), f AS (SELECT contig AS c, pos_start + 2 AS s, pos_end + 2 AS e FROM t WHERE pos_end - pos_start < 3)"


def _few(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        few = targets(spark, d).where(F.col("pos_end") - F.col("pos_start") < 3).select(F.col("contig").alias("c"), (F.col("pos_start") + 2).alias("s"), (F.col("pos_end") + 2).alias("e"))
        return interval_join(targets(spark, d).where("pos_end % 2 = 0"), few, [("contig", "c")], how=how, right_span=("s", "e"))

    return run


for _how in ("right", "full"):
    _add(f"iv_{_how}", f"{_NEAR} SELECT t.*, f.* FROM (SELECT * FROM t WHERE pos_end % 2 = 0) t {_how.upper()} JOIN f ON f.c = t.contig AND f.e >= t.pos_start AND f.s <= t.pos_end")(_few(_how))


@_add("iv_annotate_names", f"{_R} SELECT t.contig, t.pos_start, t.pos_end, string_agg(DISTINCT r.strand, ',' ORDER BY r.strand) AS strands FROM r JOIN t ON r.contig = t.contig AND {_T} GROUP BY ALL")
def iv_annotate_names(spark, d):
    t = targets(spark, d).select(F.col("contig").alias("t_contig"), F.col("pos_start").alias("t_start"), F.col("pos_end").alias("t_end")).distinct()
    j = interval_join(reads(spark, d), t, [("contig", "t_contig")], right_span=("t_start", "t_end"))
    return j.groupBy(F.col("t_contig").alias("contig"), F.col("t_start").alias("pos_start"), F.col("t_end").alias("pos_end")).agg(F.array_join(F.sort_array(F.collect_set("strand")), ",").alias("strands"))


# ordered look-ups: each asks the reads of contig 1 --------------------------------------------------------------------

_ONE = f"WITH x AS (SELECT pos_start, pos_end, n, strand FROM ({READS}) WHERE contig = '1')"
_IVS = "SELECT DISTINCT pos_start, pos_end FROM x"
_HIT = "pos_start <= 140 AND pos_end >= 101"
for _name, _f, _query in (
    ("tree_put", lambda x: ordered.put(x, ["n"]).select("pos_start", "pos_end", F.array_join(F.transform("held", lambda v: v["n"].cast("string")), ",").alias("held")), "SELECT pos_start, pos_end, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS held FROM x GROUP BY ALL"),
    ("tree_remove", lambda x: ordered.remove(x, 101, 110), "SELECT * FROM x WHERE NOT (pos_start = 101 AND pos_end = 110)"),
    ("tree_find", lambda x: ordered.find(x, 101, 110), "SELECT * FROM x WHERE pos_start = 101 AND pos_end = 110"),
    ("tree_find_by_index", lambda x: ordered.find_by_index(x, 30), f"{_IVS} ORDER BY 1, 2 OFFSET 30 LIMIT 1"),
    ("tree_get_index", lambda x: ordered.index_of(x, 101, 110).union(ordered.index_of(x, 101, 99)), f"SELECT CASE WHEN EXISTS (SELECT 1 FROM x WHERE pos_start = 101 AND pos_end = 110) THEN (SELECT count(*) FROM ({_IVS}) WHERE (pos_start, pos_end) < (101, 110)) ELSE -1 END AS index UNION ALL SELECT -1"),
    ("tree_min", lambda x: ordered.least(x).union(ordered.least(x, 101, 110)), f"(SELECT * FROM ({_IVS}) ORDER BY 1, 2 LIMIT 1) UNION ALL (SELECT * FROM ({_IVS}) WHERE (pos_start, pos_end) >= (101, 110) ORDER BY 1, 2 LIMIT 1)"),
    ("tree_max", lambda x: ordered.greatest(x).union(ordered.greatest(x, 101, 110)), f"(SELECT * FROM ({_IVS}) ORDER BY 1 DESC, 2 DESC LIMIT 1) UNION ALL (SELECT * FROM ({_IVS}) WHERE (pos_start, pos_end) <= (101, 110) ORDER BY 1 DESC, 2 DESC LIMIT 1)"),
    ("tree_min_overlapper", lambda x: ordered.first_overlapper(x, 101, 140), f"SELECT * FROM ({_IVS}) WHERE {_HIT} ORDER BY 1, 2 LIMIT 1"),
    ("tree_min_without_end", lambda x: ordered.first_without_end(x, 140), f"SELECT * FROM ({_IVS}) WHERE pos_start <= 140 ORDER BY 1, 2 LIMIT 1"),
    ("tree_min_exclude_left", lambda x: ordered.first_exclude_left(x, 101, 140), f"SELECT * FROM ({_IVS}) WHERE {_HIT} AND pos_end > 101 ORDER BY 1, 2 LIMIT 1"),
    ("tree_iterator", lambda x: ordered.in_order(x, 101, 110), "SELECT * FROM x WHERE (pos_start, pos_end) >= (101, 110)"),
    ("tree_reverse_iterator", lambda x: ordered.in_order(x, 101, 110, reverse=True), "SELECT * FROM x WHERE (pos_start, pos_end) <= (101, 110)"),
    ("tree_overlappers", lambda x: ordered.overlappers(x, 101, 140), f"SELECT * FROM x WHERE {_HIT}"),
    ("tree_overlappers_exclude_left", lambda x: ordered.overlappers_exclude_left(x, 101, 140), f"SELECT * FROM x WHERE {_HIT} AND (pos_start, pos_end) >= (SELECT (pos_start, pos_end) FROM x WHERE {_HIT} AND pos_end > 101 ORDER BY pos_start, pos_end LIMIT 1)"),
    ("tree_overlappers_without_end", lambda x: ordered.overlappers_without_end(x, 140), "SELECT * FROM x WHERE pos_start <= 140"),
    ("tree_relation", lambda x: x.groupBy(ordered.relation("pos_start", "pos_end", 101, 140).alias("relation")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN pos_start <= 140 AND pos_end >= 101 THEN 'overlapping' WHEN pos_end = 100 OR pos_start = 141 THEN 'touching' WHEN pos_end < 101 THEN 'before' ELSE 'after' END AS relation, count(*) AS n FROM x GROUP BY 1"),
):
    _add(_name, f"{_ONE} {_query}")(lambda spark, d, f=_f: f(reads(spark, d).where("contig = '1'").select("pos_start", "pos_end", "n", "strand")))
