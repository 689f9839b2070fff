"""Hash ranks, folds, occurrence counters, shards, and components of shared identities."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import rank_digest
from gaugeframe.operators.tables import cut, forget, stored


def hash_top_k(df: DataFrame, key: str, k: int, seed: object, by: list[str] | None = None) -> DataFrame:
    """The k rows of least digest, or of each group. Per group the rows are thinned in hash slices first, so that
    no task sorts a whole large group."""
    ranked = df.withColumn("_h", rank_digest(seed, F.col(key)))
    if not by:
        return ranked.orderBy("_h", key).limit(k).drop("_h")
    top = lambda d, parts: d.withColumn("_r", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", key))).where(F.col("_r") <= k)
    thinned = top(ranked.withColumn("_s", F.substring("_h", 64, 1)), [*by, "_s"]).drop("_s")
    return top(thinned, by).drop("_h", "_r")


def joined(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join on ``key`` in which nulls are equal."""
    names = {k: f"_of_{i}" for i, k in enumerate(key)}
    on = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def sliced_rank(df: DataFrame, by: list[str], piece: str, order: list, into: str) -> DataFrame:
    """The rank from 0 of each row within its group ``by``, without a task for a whole group. ``piece`` must not decrease
    along the order: rows are numbered within (group, piece), and the rows of the pieces before are added from a table
    with a row a piece. Nulls in ``by`` are a group."""
    counts = df.groupBy(*by, piece).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, piece, before.alias("_before"))
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by, piece).orderBy(*order)) - 1)
    return joined(inner, starts, [*by, piece]).withColumn(into, (F.col("_in") + F.col("_before")).cast("int")).drop("_in", "_before")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, numbered upwards in ``_piece`` and written, so that the ranges stay what they are.
    Equal values share a range."""
    return cut(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))


def fold_of_rank(df: DataFrame, task: str, key: str, folds: int, seed: object, locked: str | None = None) -> DataFrame:
    """Rank in hash order within the task, modulo folds; a locked fold holds but its row still takes a rank. Slices of
    the digest are ranked on their own, so no task sorts a whole large group."""
    ranked = df.withColumn("_h", rank_digest(seed, F.col(key))).withColumn("_piece", F.coalesce(F.substring("_h", 1, 2), F.lit("")))
    ranked = sliced_rank(ranked, [task], "_piece", ["_h", key], "_rank").withColumn("_fold", F.col("_rank") % folds)
    return ranked.withColumn("fold", F.coalesce(F.col(locked), F.col("_fold")) if locked else F.col("_fold")).drop("_h", "_piece", "_rank", "_fold")


def occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """How often the key came before, in order; a key with any number of rows is counted in ranges."""
    return sliced_rank(ranged(df, *key, *order), key, "_piece", order, "repeat_index").drop("_piece")


def average_rank(df: DataFrame, value: str, into: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 0, ties sharing their mean. Computed on distinct values with their counts, which partial
    aggregation makes smaller than the rows, in ranges of the values, and joined back; null values have no rank."""
    by = by or []
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")), *by, value)
    sums = counts.groupBy(*by, "_piece").agg(F.sum("_n").alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, "_piece", earlier.alias("_start"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = joined(counts.withColumn("_before", before), starts, [*by, "_piece"])
    ranks = ranks.select(*by, value, (F.col("_start") + F.col("_before") + (F.col("_n") - 1) / 2).alias(into))
    return joined(df, ranks, [*by, value], "left")


def strided(ordinal: Column, world: int) -> Column:
    """T6"""
    return ordinal % world


def contiguous(ordinal: Column, total: int, world: int) -> Column:
    """Null for the remainder, which is dropped."""
    size = total // world
    return F.when(ordinal < size * world, F.floor(ordinal / F.lit(max(size, 1))))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """G1: (node, root) with the least node of each component, by rounds of least labels with pointer jumping.

    Each round is written to ``spark.checkpoint.dir``, so lineage stays short and a lost executor costs a reread; the
    tables of a round go once the next one stands.
    """
    spark = edges.sparkSession
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = cut(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels, place = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root").unionByName(labels)
        least = near.groupBy("node").agg(F.min("root").alias("root"))
        jumped = least.join(labels.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root").select("node", F.least("root", "_up").alias("root"))
        step, next_place = stored(jumped.join(labels.withColumnRenamed("root", "_was"), "node").withColumn("_moved", F.col("root") != F.col("_was")))
        forget(spark, place)
        labels, place = step.select("node", "root"), next_place
        if step.where("_moved").isEmpty():
            return labels
