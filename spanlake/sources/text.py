"""Readers of line formats and Parquet, as plans of built-in sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.contigs import plain_contig
from spanlake.sources.sequences import CHUNK
from spanlake.tables import checkpointed


def _sample() -> Column:
    return F.element_at(F.split(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\."), 1)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of 3 to 12 columns: 1-based starts, plain contigs, null for missing fields or text that is no number.

    Blank lines and lines that begin with ``#``, ``track`` or ``browser`` (any case) are left out. For faulty lines with
    their reasons see ``operators.rejects``.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"(?i)^(track|browser|#)|^\s*$"))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    at = lambda i: F.get(f, i)
    number = lambda i: at(i).try_cast("int")
    numbers = lambda i: F.when(at(i) != "", F.transform(F.split(F.regexp_replace(at(i), ",$", ""), ","), lambda x: x.try_cast("int")))
    return lines.select(
        plain_contig(at(0)).alias("contig"), (number(1) + 1).alias("pos_start"), number(2).alias("pos_end"), at(3).alias("name"), number(4).alias("score"), at(5).alias("strand"),
        number(6).alias("thick_start"), number(7).alias("thick_end"), numbers(8).alias("item_rgb"), number(9).alias("block_count"), numbers(10).alias("block_sizes"), numbers(11).alias("block_starts"),
    )


def _moved(position: pd.Series, ref: pd.Series, alt: pd.Series, before: pd.Series, begin: pd.Series) -> pd.DataFrame:
    """A variant as far left as the bases ``before`` it allow, which begin at the 0-based place ``begin``; ``more``: they didn't suffice."""
    out = []
    for p, r, a, known, start in zip(position, ref, alt, before, begin, strict=True):
        more = False
        if r and a and r != a and r.isalpha() and a.isalpha():
            r, a = r.upper(), a.upper()
            while r[-1] == a[-1]:
                if min(len(r), len(a)) > 1:
                    r, a = r[:-1], a[:-1]
                elif known is None or p <= start:
                    more = known is not None and p > 0
                    break
                else:
                    p -= 1
                    base = known[p - int(start)]
                    r, a = base + r[:-1], base + a[:-1]
            while min(len(r), len(a)) > 1 and r[0] == a[0]:
                r, a, p = r[1:], a[1:], p + 1
        out.append((p, r, a, more))
    return pd.DataFrame(out, columns=["p", "r", "a", "more"])


def left_aligned(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Variants of one alternative allele each (``alt`` an array of one), without bases that both alleles share, and as far
    left as the reference (``contig``, ``chunk_start``, ``bases``) lets them go.

    A variant sees its own chunk of the reference and the one before; one that could go beyond goes on from there, for as
    many rounds as it takes, each a job that is only run while a variant is left. Symbolic, missing or equal alleles and
    contigs that the reference hasn't stay as they are. ``pos_end`` follows where it was the end of ``ref``.
    """
    chunk = F.floor(F.col("pos_start") / CHUNK).cast("int")
    own = reference.select(F.col("contig").alias("_contig"), F.floor((F.col("chunk_start") - 1) / CHUNK).cast("int").alias("_k"), "bases")
    prior = own.select(F.col("_contig").alias("_contig2"), (F.col("_k") + 1).alias("_k2"), F.col("bases").alias("_prior"))
    windows = own.join(prior, (F.col("_contig") == F.col("_contig2")) & (F.col("_k") == F.col("_k2")), "left").select("_contig", "_k", F.concat(F.coalesce("_prior", F.lit("")), "bases").alias("_bases"), (F.col("_k") * CHUNK - F.length(F.coalesce("_prior", F.lit("")))).cast("int").alias("_begin"))
    columns, moved = variants.columns, F.pandas_udf(_moved, "p int, r string, a string, more boolean")
    follows = F.col("pos_end") == F.col("pos_start") + F.length("ref")

    def step(rows: DataFrame) -> DataFrame:
        seen = rows.join(windows, (F.col("contig") == F.col("_contig")) & (chunk == F.col("_k")), "left").withColumn("_m", moved("pos_start", "ref", F.get("alt", F.lit(0)), "_bases", "_begin"))
        return seen.select(*(c for c in columns if c not in ("pos_start", "pos_end", "ref", "alt")), F.col("_m.p").alias("pos_start"), F.when(follows, F.col("_m.p") + F.length("_m.r")).otherwise(F.col("pos_end")).cast("int").alias("pos_end"), F.col("_m.r").alias("ref"), F.when(F.col("_m.a").isNotNull(), F.array("_m.a")).otherwise(F.col("alt")).alias("alt"), F.col("_m.more").alias("_more"))

    done = step(variants)
    while not done.where("_more").isEmpty():
        done = checkpointed(done)
        done = done.where("NOT _more").unionByName(step(done.where("_more").drop("_more")))
    return done.select(*columns)


def vcf(spark: SparkSession, path: str, split_alleles: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """``contig`` (plain), ``pos_start`` (0-based), ``pos_end``, ``names``, ``ref``, ``alt`` (array), ``qual``, ``filters``, ``info`` (map), ``genotypes``.

    ``genotypes`` holds a map of the FORMAT keys for each sample, in the file's order. Records with several alternative
    alleles stay whole, or with ``split_alleles`` become a row for each; with a ``reference`` they do, and are ``left_aligned``. ``pos_end`` is INFO's END if it is there.
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    at = lambda i: F.get(f, i)
    dot = lambda c: F.when(c != ".", c)
    many = lambda c, sep: F.when(c.isNull() | (c == "."), F.array().cast("array<string>")).otherwise(F.split(c, sep))
    pair = lambda x: F.struct(F.get(F.split(x, "="), 0).alias("key"), F.get(F.split(x, "=", 2), 1).alias("value"))
    # a key that is repeated counts once, as it comes first
    first_of = lambda pairs: F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["key"]), x["key"]) == i + 1)
    keys = F.split(at(8), ":")
    own = F.transform(F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))), lambda s: F.map_from_entries(F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(F.split(s, ":"), i).alias("value"))), lambda e: e["value"].isNotNull())))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        plain_contig(at(0)).alias("contig"), (at(1).try_cast("int") - 1).alias("pos_start"), F.length(at(3)).alias("_n"), many(at(2), ";").alias("names"), at(3).alias("ref"), many(at(4), ",").alias("alt"),
        dot(at(5)).try_cast("double").alias("qual"), many(at(6), ";").alias("filters"), F.map_from_entries(first_of(F.transform(many(at(7), ";"), pair))).alias("info"),
        F.when(F.size(f) > 9, own).alias("genotypes"),
    )
    end = F.coalesce(F.try_element_at("info", F.lit("END")).try_cast("int"), F.col("pos_start") + F.col("_n"))
    rows = rows.withColumn("pos_end", end).select("contig", "pos_start", "pos_end", "names", "ref", "alt", "qual", "filters", "info", "genotypes")
    if split_alleles or reference is not None:
        rows = rows.withColumn("alt", F.explode_outer(F.transform("alt", lambda a: F.array(a))))
    return rows if reference is None else left_aligned(rows, reference)


def parquet_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Parquet alignments or features with ``contigName``, ``start``, ``end``, renamed; values as the file has them."""
    return spark.read.parquet(path).withColumnsRenamed({"contigName": "contig", "start": "pos_start", "end": "pos_end"})


def mpileup(spark: SparkSession, path: str) -> DataFrame:
    return pileup_text(spark, path, "contig string, pos int, ref string, coverage int, pileup string, quality string", "\t", "\u0000")


def spaced_pileup(spark: SparkSession, path: str) -> DataFrame:
    return pileup_text(spark, path, "contig string, pos int, ref string, pileup string, quality string", " ")


def block_pileup(spark: SparkSession, path: str) -> DataFrame:
    """What ``sinks.write_pileup`` wrote."""
    return pileup_text(spark, path, "contig string, pos_start int, pos_end int, ref string, coverage int, alts string, quals string", "|")


def pileup_text(spark: SparkSession, path: str, schema: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    return spark.read.format("csv").schema(schema).option("delimiter", delimiter).option("quote", quote).load(path)


def targets(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, every column a string."""
    return spark.read.option("header", "true").option("delimiter", "\t").csv(path)
