"""Partitions of inputs, and the folder that all executors share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lectern.shipping import ship


def spread(scan: DataFrame) -> DataFrame:
    """Repartition the scan of a table that has fewer partitions than there are
    cores (one small file); any larger one is left as it is, without a shuffle.
    For scans only: of a derived table, counting would run the shuffles."""
    ship(scan.sparkSession)
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hadoop(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of any folder that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's JVM ends."""
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.  A
    local default is set only where it is unset and the executors are threads of
    this machine; on a cluster that setting is needed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file:///tmp/lectern-checkpoint-{os.getpid()}"
        drop_at_exit(spark, found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder.  Spark
    removes its files once the result is no longer referenced where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
