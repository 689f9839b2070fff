"""Checks that return the rows that violate them; an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_empty(violations: DataFrame, what: str) -> None:
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")


def coverage(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are missing or extra, by two anti joins."""
    e, f = expected.select(*key).distinct(), found.select(*key).distinct()
    return e.join(f, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("status", F.lit("extra")))


def drift(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides whose columns differ, nulls being equal: key, column, left and right value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l.{c}").cast("string").alias("left_value"), F.col(f"r.{c}").cast("string").alias("right_value")) for c in columns])
    joined = left.alias("l").join(right.alias("r"), key).select(*key, F.explode(pairs).alias("p")).select(*key, "p.*")
    return joined.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def crossing(df: DataFrame, identity: str, fold: str) -> DataFrame:
    """§1.3: identities that occur in more than one fold."""
    return df.groupBy(identity).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def binary_hit(c: Column) -> Column:
    """0 or 1 after numeric coercion; anything else is refused."""
    v = c.try_cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit("not a hit: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("tinyint"))


def uid_parts(c: Column) -> Column:
    """(benchmark, split, index) of a uid; null unless it has three parts, none empty."""
    p = F.split(c, "::")
    return F.when((F.size(p) == 3) & ~F.array_contains(p, ""), F.struct(p[0].alias("benchmark"), F.get(p, F.lit(1)).alias("split"), F.get(p, F.lit(2)).alias("index")))


def typed_id(c: Column) -> Column:
    """P5"""
    return c.rlike(r"^i2[it]:[A-Za-z0-9_.-]+$")


def conversations(df: DataFrame, human: str = "user", answer: str = "assistant") -> DataFrame:
    """A row for each conversation that breaks a rule, with the first rule it breaks. Aggregates only: no turn
    list is built, so a conversation may be of any length."""
    at = F.struct("turn", "role", "text")
    marks = lambda role: F.sum(F.when(F.col("role") == role, F.regexp_count(F.coalesce("text", F.lit("")), F.lit("<image>"))).otherwise(0))
    rows = df.groupBy("conv_id").agg(
        F.min_by("role", at).alias("first"),
        F.count_if(F.col("role") == answer).alias("answers"),
        F.count_if((F.col("role") == answer) & (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("empty"),
        marks(answer).alias("marked"),
        marks(human).alias("images"),
        F.count_if(~F.col("role").isin(human, answer)).alias("other"),
    )
    fault = F.when(F.col("first") != human, "must start with a human turn").when(F.col("images") > 1, "more than one image").when(F.col("other") > 0, "unsupported role")
    fault = fault.when((F.col("marked") > 0) | (F.col("empty") > 0), "invalid answer").when(F.col("answers") == 0, "no answer")
    return rows.select("conv_id", fault.alias("fault")).where("fault IS NOT NULL")


def shared(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """U4: the keys that both sides have, once each, nulls being equal: none, where one excludes the other."""
    return left.select(*key).intersect(right.select(*key))
