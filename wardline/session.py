"""Session settings shared by tests, benchmarks and queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects: UTC, adaptive execution, checkpoints set."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WARDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables under a directory; works for any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a part of a spread table.
SPREAD_ROWS = 50_000


def parts_for(df: DataFrame) -> int:
    """How many parts ``df``, a scan, is dealt to for heavy work per row: as many for each core, and more as it grows, so that no task does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-df.count() // (SPREAD_ROWS * cores)))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows of a scan dealt to all cores, and to as many parts as it has ``SPREAD_ROWS``, where its files give fewer.

    For heavy work per row on a table of few files, which Spark can't split
    below a row group. A scan of as many parts stays as it is, unshuffled. The
    rows are counted first (of Parquet, from the footers). With ``by`` rows that
    agree in those columns come into one part, so that groupings, windows and
    joins by them shuffle no more.
    """
    parts = parts_for(df)
    if by:
        return df.repartition(parts, *by)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder all executors share, under ``spark.checkpoint.dir``.

    Where that is unset it is under /tmp on one machine (tests); on a cluster
    that is an error. The folder goes when the driver ends in good order.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{base or '/tmp/checkpoints'}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
