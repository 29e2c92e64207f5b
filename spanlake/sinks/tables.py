"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def write_pileup(df: DataFrame, path: str, single_file: bool = False) -> None:
    """``|``-separated text, maps as strings. One file only where the caller knows it to be small."""
    out = df.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in df.schema))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("delimiter", "|").csv(path)


def write_report(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """Tab-separated with a header, in order over the sorted parts; one file only where the caller knows it to be small."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", "true").option("delimiter", "\t").csv(path)


def save_by_sample(df: DataFrame, path: str, overwrite_samples: bool = False, format: str = "parquet") -> None:  # noqa: A002
    """Appends to a folder partitioned by ``sample_id``, or replaces the samples that ``df`` has and no other.

    Rows are spread by sample and a hash of their place, so that a sample that holds most rows is written by many tasks.
    """
    place = F.pmod(F.xxhash64(*[c for c in ("contig", "pos_start") if c in df.columns]), F.lit(64)) if "contig" in df.columns else F.lit(0)
    writer = df.repartition("sample_id", place).write.format(format).partitionBy("sample_id")
    if overwrite_samples:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode("append").save(path)
