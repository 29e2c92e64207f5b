"""Where a query finds its tables, how small files are spread, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from spanlake.sources.files import opened

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of Parquet files over all cores, where the files have fewer row groups, which is what a scan can be split into.

    For tables whose rows take long. Where there is a row group for each core, as in any large table, nothing is shuffled;
    footers are read only where there are fewer files than cores.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    groups = 0
    for path in files:
        with opened(unquote(path)) as f:
            groups += pq.ParquetFile(f).num_row_groups
    return df if groups >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local session (tests, a laptop) gets a folder of its own;
    on a cluster a folder of one machine would lose what the others wrote, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="spanlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path for files of a query, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, written to the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()
