"""Unions, variants, rotations, intervals and running sums."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.operators.sampling import joined, ranged, sliced_rank
from gaugeframe.operators.tables import cut


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All parts by name, missing columns null, each row tagged with its part."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in parts.items()])


def circular_variants(df: DataFrame, options: list[str], answer: str, index: str, offset: int = 1_000_000) -> DataFrame:
    """Of each row, one variant for each rotation r of the options: option i becomes option i + r, the answer letter
    moves along, and the index grows by r times ``offset``."""
    n = len(options)
    turned = [F.element_at(F.array(*[F.col(o) for o in options]), ((F.lit(i) + F.col("_r")) % n + 1).cast("int")).alias(o) for i, o in enumerate(options)]
    place = F.array_position(F.array(*[F.lit(o) for o in options]), F.col(answer)) - 1
    letter = F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(place - F.col("_r"), F.lit(n)) + 1).cast("int"))
    keep = [c for c in df.columns if c not in (*options, answer, index)]
    return df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*keep, (F.col(index) + F.col("_r") * offset).alias(index), F.col(index).alias("g_index"), *turned, letter.alias(answer))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each group joined (gaps and islands).

    Rows are joined in ranges of their start first, so no task has a whole large group. What is left is written, and an
    island that the ranges before it reach goes on from theirs; the rows themselves are looked at once.
    """
    rows = df.select(*by, start, end).repartitionByRange(*by, start, end).withColumn("_piece", F.spark_partition_id())
    inner = Window.partitionBy(*by, "_piece").orderBy(start, end)
    opens = F.coalesce(F.col(start) > F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    local = rows.withColumn("_new", opens.cast("int")).withColumn("_in", F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut(local.groupBy(*by, "_piece", "_in").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")))

    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.groupBy(*by, "_piece").agg(F.max(end).alias("_far")).select(*by, "_piece", F.max("_far").over(before).alias("_reach"))
    flagged = joined(parts, reach, [*by, "_piece"]).withColumn("_new", F.coalesce(F.col(start) > F.col("_reach"), F.lit(True)).cast("int"))
    opened = flagged.groupBy(*by, "_piece").agg(F.sum("_new").alias("_o")).select(*by, "_piece", F.coalesce(F.sum("_o").over(before), F.lit(0)).alias("_start"))
    place = F.sum("_new").over(Window.partitionBy(*by, "_piece").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0))
    island = joined(flagged.withColumn("_at", place), opened, [*by, "_piece"]).withColumn("_i", F.col("_at") + F.col("_start"))
    return island.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("merged").alias("merged")).drop("_i")


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key, by one partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def offset_running_sum(df: DataFrame, bucket: Column, order: list[str], value: Column, into: str) -> DataFrame:
    """A running sum in a global order without one task for all rows, or for all buckets. ``bucket`` must not
    decrease along the order, nulls come first; rows are summed within it. The sums of buckets are summed in ranges, and
    what one task sees in a row is a number for each range."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = ranged(rows.groupBy("_b").agg(F.sum("_v").alias("_s")), "_b")
    earlier = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.groupBy("_piece").agg(F.sum("_s").alias("_t")).select("_piece", earlier("_t", Window.orderBy("_piece")).alias("_start"))
    before = sums.withColumn("_within", earlier("_s", Window.partitionBy("_piece").orderBy("_b"))).join(starts, "_piece")
    before = before.select("_b", (F.col("_within") + F.col("_start")).alias("_before"))
    inner = F.sum("_v").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined(rows.withColumn("_in", inner), before, ["_b"]).withColumn(into, F.col("_in") + F.col("_before")).drop("_b", "_v", "_in", "_before")


#: Values of a dimension up to which they are broadcast; beyond, the grid is refused.
MOST_VALUES = 1_000_000


def missing_grid(df: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of dimension values that have no row. ``b`` must have at most ``MOST_VALUES`` values."""
    columns = cut(df.select(b).distinct())
    if columns.count() > MOST_VALUES:
        raise ValueError(f"{b} has more than {MOST_VALUES} values")
    grid = df.select(a).distinct().join(F.broadcast(columns))
    return grid.join(df.select(a, b).distinct(), [a, b], "left_anti")


def self_reference(df: DataFrame, index: str, payload: str, longest: int = 64) -> DataFrame:
    """A short payload is the index of the row that holds the real one. Long payloads aren't join keys: they meet
    nothing and are moved only to the rows that point at them."""
    pointing = F.when(F.length(payload) <= longest, F.col(payload))
    wanted = df.select(pointing.alias("_i")).where("_i IS NOT NULL").distinct()
    source = df.select(F.col(index).cast("string").alias("_i"), F.col(payload).alias("_p")).join(wanted, "_i", "left_semi")
    joined = df.withColumn("_to", pointing).join(source, F.col("_to") == F.col("_i"), "left")
    return joined.withColumn(payload, F.coalesce("_p", payload)).drop("_i", "_p", "_to")


def pairs_in_order(df: DataFrame, value: str) -> DataFrame:
    """F64: (pair, front, back): the distinct values in order, two by two; an odd last one is left out."""
    placed = sliced_rank(ranged(df.select(value).where(F.col(value).isNotNull()).distinct(), value), [], "_piece", [value], "_i")
    side = lambda k: F.max(F.when(F.col("_i") % 2 == k, F.col(value)))
    return placed.groupBy(F.floor(F.col("_i") / 2).cast("int").alias("pair")).agg(side(0).alias("front"), side(1).alias("back"), F.count("*").alias("_n")).where("_n = 2").drop("_n")


def plain_names(df: DataFrame) -> DataFrame:
    """Names in lower case, but for single letters from A to Z."""
    return df.toDF(*[n if len(n) == 1 and "A" <= n <= "Z" else n.lower() for n in df.columns])


def choice_map(columns: list[str]) -> Column:
    """Letter to text of the columns A to Z that a row has a value for."""
    letters = [n for n in columns if len(n) == 1 and "A" <= n <= "Z"]
    pairs = [x for n in letters for x in (F.lit(n), F.col(n).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def open_questions(df: DataFrame, answer: str) -> DataFrame:
    """A question without option A becomes one of two options: its answer, and any other."""
    return df.withColumns({"A": F.coalesce("A", answer), "B": F.when(F.col("A").isNull(), F.lit("Other Answers")).otherwise(F.col("B"))})


def carried_over(items: DataFrame, results: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Of each item its newest result, nulls where there is none yet."""
    return items.join(latest(results, key, order), key, "left")
