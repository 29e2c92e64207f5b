"""Readers. ``register`` adds the binary and record formats to a session under ``bam``, ``cram``, ``fastq`` and ``fasta``."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from spanlake.sources.bam import BamSource, CramSource
    from spanlake.sources.sequences import FastaSource, FastqSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the readers leave out files and records by filters
    for source in (BamSource, CramSource, FastqSource, FastaSource):
        spark.dataSource.register(source)
