"""The last receipt of each job as keyed state in a stream.

The state store holds one small row a key. A batch reads the state of the keys that it has receipts of, and writes the
rows that change; nothing else is read or written, however many keys there are. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from gaugeframe.operators.receipts import latest_status

#: The state store that keyed state needs, set for the stream's own session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Latest(StatefulProcessor):
    """Keeps of each key the values of ``at``, by which receipts are ordered, and of ``status``, and passes a receipt on
    if it is newer. A key whose status is one of ``waiting`` for ``stall`` milliseconds without a newer receipt is
    passed on once more as ``stalled``."""

    def __init__(self, columns: list[str], key: list[str], at: list[str], status: str, kept: str, waiting: tuple[str, ...], stall: int | None) -> None:
        self.columns, self.key, self.at, self.status, self.kept, self.waiting, self.stall = columns, key, at, status, kept, waiting, stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for b in rows:
            # Nulls among the ordering values come first, as in a batch.
            top = b.sort_values(self.at, na_position="first", kind="stable").iloc[[-1]]
            place = tuple(None if pd.isna(x) else int(x) for x in top[self.at].iloc[0])
            if best is None or _later(place, best[0]):
                best = place, top
        known = tuple(self.last.get())[: len(self.at)] if self.last.exists() else None
        if best is None or (known is not None and not _later(best[0], known)):
            return
        place, top = best
        state = top[self.status].iloc[0]
        self.last.update((*place, state))
        if self.stall is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state in self.waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stall)
        yield top.assign(stalled=False)[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *place, state = self.last.get()
        known = {**dict(zip(self.key, key, strict=True)), **dict(zip(self.at, place, strict=True)), self.status: state, "stalled": True}
        yield pd.DataFrame([[known.get(c) for c in self.columns]], columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def _later(a: tuple, b: tuple) -> bool:
    """Whether ``a`` comes after ``b``; nulls come first."""
    return [(x is not None, x or 0) for x in a] > [(x is not None, x or 0) for x in b]


def latest_changes(receipts: DataFrame, key: list[str], at: list[str], status: str, waiting: tuple[str, ...] = ("running",), stall: int | None = None) -> DataFrame:
    """The receipts of a stream that are newer, by the whole numbers ``at``, than all before of their key, with
    ``stalled``; of a batch only the newest of each key. A stalled row has its key, ``at`` and ``status``, other columns
    are null. Keys may be null; receipts that tie in ``at`` with the last one change nothing."""
    columns = [*receipts.columns, "stalled"]
    kinds = {f.name: f for f in receipts.schema.fields}
    kept = ", ".join([*(f"`{c}` long" for c in at), f"`{status}` {kinds[status].dataType.simpleString()}"])
    out = StructType([StructField(f.name, f.dataType) for f in receipts.schema.fields] + [StructField("stalled", BooleanType())])
    processor = Latest(columns, key, at, status, kept, waiting, stall)
    return receipts.groupBy(*key).transformWithStateInPandas(processor, out, "Update", "None" if stall is None else "ProcessingTime")


def store_changes(changes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch's changes in a folder of their own below ``path``; a batch that is run again overwrites its own. What
    is there is read once, or for as long as the stream is left running where ``every`` says how often: stalled keys
    need that, as their timers go off by the clock."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application with settings of its own, in which keyed state can run."""
    own = spark.newSession()
    own.conf.set(*STORE)
    return own


def current(spark: SparkSession, path: str, key: list[str], at: list[str]) -> DataFrame:
    """The last row of each key over all stored changes; a stalled row comes after the receipt that it is about."""
    rows = spark.read.parquet(path)
    return latest_status(rows, key, F.struct(*at, "stalled", "batch")).drop("batch")


def streamed(spark: SparkSession, folder: str, schema: StructType, key: list[str], at: list[str], status: str, path: str, checkpoint: str) -> None:
    """Bring the changes below ``path`` up to date with the Parquet files in ``folder``, and end."""
    rows = session(spark).readStream.schema(schema).parquet(folder)
    store_changes(latest_changes(rows, key, at, status), path, checkpoint).awaitTermination()
