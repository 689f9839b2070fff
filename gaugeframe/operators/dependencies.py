"""Chains of dependent jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.tables import cut
from gaugeframe.operators.validation import assert_empty, duplicates


def ancestors(jobs: DataFrame, job: str, parent: str) -> DataFrame:
    """(job, ancestors, root): how many jobs each one waits for, one after the other, and the first of them.

    Every round doubles the step by which a job looks up, so a chain of any length takes its logarithm of joins, each
    written to the shared folder. A job that is there twice, a parent that isn't there, and a ring are errors.
    """
    rows = cut(jobs.select(F.col(job).alias("job"), F.col(parent).alias("up")))
    assert_empty(duplicates(rows, ["job"]), "repeated jobs")
    assert_empty(rows.where("up IS NOT NULL").join(rows.select(F.col("job").alias("up")), "up", "left_anti"), "missing parents")
    most = max(1, rows.count()).bit_length()
    at = rows.select("job", "up", F.col("up").isNotNull().cast("long").alias("n"), F.coalesce("up", "job").alias("root"))
    for _ in range(most + 1):
        if at.where("up IS NOT NULL").isEmpty():
            return at.select(F.col("job").alias(job), F.col("n").alias("ancestors"), "root")
        over = at.select(F.col("job").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("root").alias("_root"))
        # Those that have reached a root stay as they are and aren't joined.
        going = at.where("up IS NOT NULL").join(over, "up").select("job", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n"), F.col("_root").alias("root"))
        at = cut(at.where("up IS NULL").unionByName(going))
    raise ValueError(f"jobs wait for each other in a ring: {at.where('up IS NOT NULL').select('job').limit(5).collect()}")
