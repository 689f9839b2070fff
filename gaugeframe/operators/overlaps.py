"""Intervals that overlap, from rows: no group is collected, and no two rows meet that can't overlap.

An interval of length n belongs to level ceil(log2(n)) and lies in at most two cells of that level's grid; it is also
placed in its cells of every coarser level that occurs. Two intervals that overlap share a cell at the coarser of their
levels, so they meet there by an equality, and a group with many intervals is spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.reshape import merge_intervals
from gaugeframe.operators.sampling import joined


def _levels(df: DataFrame, start: str, end: str) -> DataFrame:
    size = F.col(end) - F.col(start)
    return df.withColumn("_level", F.ceil(F.log2(size)).cast("int")).where(size > 0)


def _placed(df: DataFrame, levels: list[int], start: str, end: str) -> DataFrame:
    """A row for each cell: ``_at``, its level, and ``_own``, whether that is the interval's level."""
    cell = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level))
    wider = F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("_level"))
    rows = df.withColumn("_at", F.explode(wider))
    # The end is open: what ends at a cell's start isn't in it.
    last = F.greatest(F.ceil(F.col(end) / F.pow(F.lit(2.0), F.col("_at"))) - 1, cell(F.col(start), F.col("_at")))
    return rows.withColumn("_cell", F.explode(F.sequence(cell(F.col(start), F.col("_at")), last))).withColumn("_own", F.col("_at") == F.col("_level")).drop("_level")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, left, right, overlap): each pair of a left and a right row of the same ``by`` whose intervals share more than
    a point, as structs of the other columns, with the length that they share. Null keys are equal; intervals without
    length, or with a null, overlap nothing; repeated rows pair as often as they come."""
    sides, levels = [], set()
    for df in (left, right):
        rest = [c for c in df.columns if c not in by]
        named = df.select(*by, F.struct(*rest).alias("_row"), F.col(start).cast("double").alias("_from"), F.col(end).cast("double").alias("_to"))
        sides.append(_levels(named, "_from", "_to"))
        levels |= {r[0] for r in sides[-1].select("_level").distinct().collect()}  # at most one for each exponent
    if not levels:
        levels = {0}
    a, b = (_placed(s, sorted(levels), "_from", "_to") for s in sides)
    a = a.withColumnsRenamed({"_row": "left", "_from": "_a", "_to": "_b", "_own": "_mine"})
    met = joined(a, b.withColumnRenamed("_row", "right"), [*by, "_at", "_cell"])
    low, high = F.greatest("_a", "_from"), F.least("_b", "_to")
    # At the coarser of both levels, and once: in the cell where the overlap begins.
    once = (F.col("_mine") | F.col("_own")) & (low < high) & (F.floor(low / F.pow(F.lit(2.0), F.col("_at"))) == F.col("_cell"))
    return met.where(once).select(*by, "left", "right", (high - low).alias("overlap"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], key: str, start: str = "start", end: str = "end") -> DataFrame:
    """For each left ``key`` the right ``key`` with the greatest share of overlap, ties going to the smallest, and
    that share; null and 0 where nothing overlaps."""
    pairs = overlapping(left, right, by, start, end)
    size = lambda side: F.col(f"{side}.{end}").cast("double") - F.col(f"{side}.{start}").cast("double")
    iou = F.col("overlap") / (size("left") + size("right") - F.col("overlap"))
    best = pairs.select(*by, F.col(f"left.{key}").alias(key), F.col(f"right.{key}").alias("_key"), iou.alias("_iou")).groupBy(*by, key).agg(F.min(F.struct(-F.col("_iou"), "_key")).alias("_best"))
    best = best.select(*by, key, F.col("_best._key").alias("match"), (-F.col("_best.col1")).alias("iou"))
    return joined(left.select(*by, key), best, [*by, key], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def sets_iou(left: DataFrame, right: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, iou) of the sets of points that the intervals of each side cover: what both cover is what each covers
    less what they cover together, so three merges suffice and no pairs are made. 0 where nothing is covered."""
    both = [df.select(*by, F.col(start).cast("double").alias("_from"), F.col(end).cast("double").alias("_to")) for df in (left, right)]
    both.append(both[0].unionByName(both[1]))
    parts = [merge_intervals(df, by, "_from", "_to").select(*by, (F.col("_to") - F.col("_from")).alias("_size"), F.lit(sign).alias("_sign")) for df, sign in zip(both, (1, 1, -1), strict=True)]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*by).agg(F.sum(F.col("_size") * F.col("_sign")).alias("_shared"), F.sum(F.when(F.col("_sign") < 0, F.col("_size"))).alias("_all"))
    return sums.select(*by, F.coalesce(F.try_divide(F.col("_shared"), F.col("_all")), F.lit(0.0)).alias("iou"))
