"""Status receipts: the last state of each job, in batch; the streaming form is in ``gaugeframe.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_status(df: DataFrame, key: list[str], at: Column) -> DataFrame:
    """One row a key, the last by ``at``. Partial aggregation keeps one row a key and task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*")


def diagnostics(df: DataFrame, log: Column) -> DataFrame:
    """How many logs fell back to exact matching and how many judge replies stayed unresolved."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.contains(log, F.lit("Exact matching fallback:"))).alias("fallbacks"),
        F.count_if(F.contains(log, F.lit("Unresolved LLM judge response."))).alias("unresolved"),
    )


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")
