"""Shared scratch tables: the folder named by ``spark.checkpoint.dir``, or a fresh one in tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path.

    Only a local session that names none gets a temporary folder of its own: on a cluster
    every executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    mine = getattr(shared_dir, "local", None)
    if mine is None:
        mine = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return mine


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillgraph/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all this application has written to the shared folder, once its results are used."""
    remove(spark, _own(spark))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in ``path``, which need not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def dealt(df: DataFrame) -> DataFrame:
    """``df``, a table as read, over all cores. A small table in few files, whose rows may all lie
    in one row group, would keep one core busy; larger ones stay as their splits are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= 4 * cores:
        return df.repartition(cores)
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result's lineage starts at replicated files, so a lost executor costs at most
    the tasks it was running.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
