"""Documents of any shape as rows of paths, by the variant type: no schema is given or inferred."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.tables import cut


def json_paths(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, path, value): a row for each leaf of each JSON text, in which objects are told by ``.name`` and arrays by
    ``[place]``; a leaf alone has an empty path. Values are texts, a JSON null is null, and empty objects and arrays are
    the leaves ``{}`` and ``[]``.

    A level is opened at a time, for the rows that have one more. Null and broken texts have no rows; repeated rows come
    as often; keys may be null.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("_v")).where(F.col("_v").isNotNull())
    leaves = []
    while True:
        level = cut(level.withColumn("_kind", F.substring(F.schema_of_variant("_v"), 1, 1)))
        nested = F.col("_kind").isin("O", "A") & ~F.to_json("_v").isin("{}", "[]")
        leaves.append(level.where(~nested).select(*keys, "path", F.when(F.col("_kind").isin("O", "A"), F.to_json("_v")).otherwise(F.try_variant_get("_v", "$", "string")).alias("value")))
        deeper = level.where(nested)
        if deeper.isEmpty():
            return functools.reduce(DataFrame.unionByName, leaves)
        below = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos"), F.lit("]")))
        level = deeper.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*keys, below.alias("path"), F.col("value").alias("_v"))


def merged_paths(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """``over`` laid over ``base``, both (keys, path, value): a leaf of ``over`` takes the place of the leaf of that path,
    of all below it, and of a leaf that it lies below. Keys that only one side has stay; null keys are equal.

    Neither join may broadcast: paths take a few bytes on disk and some hundred times that as a table in memory."""
    from gaugeframe.operators.sampling import joined

    # Each path with those that it lies below, itself included, so that covering is an equality.
    steps = F.regexp_extract_all("path", F.lit(r"(\.[^.\[]*|\[[0-9]+\])"), F.lit(1))
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ""))
    up = over.select(*keys, F.explode(above).alias("path")).distinct()
    down = base.withColumn("_up", F.explode(above))
    hidden = joined(down.select(*keys, F.col("path").alias("_path"), F.col("_up").alias("path")), over.select(*keys, "path").distinct().hint("merge"), [*keys, "path"], "left_semi").select(*keys, F.col("_path").alias("path"))
    gone = hidden.unionByName(up).distinct()
    return joined(base, gone.hint("merge"), [*keys, "path"], "left_anti").unionByName(over)
