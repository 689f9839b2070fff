"""Receipts and event windows as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeframe.operators.receipts import latest_status


def upsert(batch: DataFrame, path: str, key: list[str], at: Column) -> None:
    """The last row of each key over the stored table and a batch. Versions are folders ``v=N``; a reader takes the
    greatest, so a failed write leaves the former table as it is. The version before the new one stays for readers that
    have begun; older ones go. An empty batch writes nothing."""
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    done = sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    rows = batch.unionByName(spark.read.parquet(f"{path}/v={done[-1]}")) if done else batch
    latest_status(rows, key, at).write.mode("overwrite").parquet(f"{path}/v={done[-1] + 1 if done else 0}")
    for n in done[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}"), True)


def current(spark, path: str) -> DataFrame:
    """The newest complete version."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/v={max(done)}")


def status_stream(events: DataFrame, path: str, checkpoint: str, key: list[str], at: Column) -> StreamingQuery:
    """Late receipts overwrite by time, whatever the order of arrival."""
    return events.writeStream.foreachBatch(lambda batch, _: upsert(batch, path, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """An extension: counts by tumbling window with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count("*").alias("n"))
