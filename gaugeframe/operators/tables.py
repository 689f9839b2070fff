"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a local session (a test) gets a folder of this
    machine; on a cluster each executor would write to a disk of its own, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/gaugeframe-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def forget_on_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends: tables that are read lazily may be asked for until then."""
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)


def place(spark: SparkSession) -> str:
    """A path in a new scratch folder that goes when the driver ends, for writers that make their own files."""
    folder = scratch(spark)
    fs, where = _at(spark, folder)
    fs.mkdirs(where)
    forget_on_exit(spark, folder)
    return f"{folder}/table"


def forget(spark: SparkSession, path: str) -> None:
    """Delete ``path`` now; for tables that nothing reads any more."""
    fs, where = _at(spark, path)
    fs.delete(where, True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new scratch path and read back, and that path."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    forget_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs a reread
    and not a recomputation. The writer commits by task, and retried tasks leave no double rows."""
    return stored(df)[0]
