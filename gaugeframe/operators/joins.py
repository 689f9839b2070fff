"""Joins that are checked, chained or rolled up a hierarchy."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.reshape import MOST_VALUES, tagged_union
from gaugeframe.operators.tables import cut


def asserted(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """An inner join in which every left row must find its one partner. The check rides along as a column
    of the join, so nothing is scanned twice: a row without a partner fails the query when it is read."""
    one = right.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in right.columns if c not in key])).alias("_r"))
    joined = left.join(one, key, "left")
    what = F.concat(F.lit("no single partner for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))
    checked = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
    return joined.where(checked).select(*left.columns, "_r.*")


def known_only(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is known."""
    return left.join(right.select(*key).distinct(), key, "left_semi")


def chained(base: DataFrame, steps: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Left joins one after the other, each step's columns with its name as suffix."""

    def add(acc: DataFrame, step: tuple[str, DataFrame]) -> DataFrame:
        name, df = step
        return acc.join(df.select(*key, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in key]), key, "left")

    return functools.reduce(add, steps.items(), base)


def up_hierarchy(df: DataFrame, node: str, value: Column, parents: DataFrame, root: str) -> DataFrame:
    """The mean of each node, then the mean of the nodes below each root; nodes without a parent have none."""
    means = df.groupBy(node).agg(F.avg(value).alias("_m"))
    return means.join(parents.select(node, root), node, "left").groupBy(root).agg(F.count("*").alias("nodes"), F.avg("_m").alias("mean"))


def grid_difference(found: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The cells of rows x columns that are missing and those that don't belong, each with its status."""
    key = [*rows.columns, *columns.columns]
    side = cut(columns.distinct())
    if side.count() > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} columns")
    grid = rows.distinct().join(F.broadcast(side))
    have = found.select(*key).distinct()
    return grid.join(have, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(have.join(grid, key, "left_anti").withColumn("status", F.lit("extra")))


def by_digest(df: DataFrame, wanted: DataFrame, parts: list[str]) -> DataFrame:
    """Rows whose digest over ``parts`` is wanted (column ``digest``)."""
    digest = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    return df.withColumn("digest", digest).join(wanted.select("digest").distinct(), "digest", "left_semi")


def fold_conflicts(*tables: tuple[DataFrame, Column, str]) -> DataFrame:
    """Identities, listed in an array column, that several tables put into different folds."""
    every = functools.reduce(DataFrame.unionByName, [df.select(F.explode(ids).alias("identity"), F.col(fold).alias("fold")) for df, ids, fold in tables])
    return every.groupBy("identity").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def first_seen(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Distinct keys with the place where each is first seen."""
    return df.groupBy(*key).agg(F.min(ordinal).alias("first"))


def display_order(c: Column, preferred: list[str]) -> list[Column]:
    """Preferred names in their order, then the rest by name."""
    place = F.array_position(F.array(*map(F.lit, preferred)), c)
    return [F.when(place > 0, place).otherwise(len(preferred) + 1).asc(), c.asc()]


def gated(df: DataFrame, target: Column, drawn_before: Column, cap: int) -> DataFrame:
    """Rows of the gated groups only until ``cap`` target rows were drawn; target rows always."""
    return df.where(target | (drawn_before < cap))


def epochs(df: DataFrame, n: int) -> DataFrame:
    """The rows again for every epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def patch_positions(width: Column, height: Column, side: int, per_row: int) -> Column:
    """Flat position ids of the patches of an image, row by row, on a grid of ``per_row`` columns."""
    rows, cols = F.floor(height / side).cast("int"), F.floor(width / side).cast("int")
    each = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: r * per_row + c))
    return F.when((rows > 0) & (cols > 0), F.flatten(each)).otherwise(F.array().cast("array<int>"))


def map_scores(found: Column, truth: Column) -> Column:
    """(equal, jaccard over keys of equal values, recall of exact pairs) of two maps."""
    same = F.size(F.map_filter(truth, lambda k, v: F.element_at(found, k).eqNullSafe(v) & F.map_contains_key(found, k)))
    keys = F.size(F.array_union(F.map_keys(found), F.map_keys(truth)))
    share = lambda n: F.coalesce(F.try_divide(same.cast("double"), n), F.lit(1.0))
    return F.struct(((same == F.size(truth)) & (same == F.size(found))).alias("equal"), share(keys).alias("jaccard"), share(F.size(truth)).alias("recall"))


def json_rank(seed: int, key: Column) -> Column:
    """The digest of the JSON list [seed, "key"] in compact form."""
    quoted = F.regexp_replace(F.to_json(F.struct(key.alias("k"))), r"^\{\"k\":(.*)\}$", "$1")
    return F.sha2(F.concat(F.lit(f"[{seed},"), quoted, F.lit("]")), 256)


def original_rows(asked: DataFrame, parts: dict[str, DataFrame], tag: str, place: str, key: str) -> DataFrame:
    """``asked`` with the row of its part that it came from; a tag without a part has none."""
    every = tagged_union(parts, "_part").withColumnRenamed(key, "_key")
    return asked.join(every, (F.col(tag) == F.col("_part")) & (F.col(place) == F.col("_key")), "left").drop("_part", "_key")
