"""Exact quantiles of groups of any size.

Spark's exact percentile holds all values of a group in one buffer. Here a group's wanted ranks are closed in first: a
sketch of bounded size gives an even grid of values, the rows of the cells around the wanted ranks stay, and what lies
below them is counted exactly; so each round leaves about one row in a hundred. What is left is summed to distinct
values with their counts and picked by running sums. A group of at most ``SMALL`` rows is left to Spark at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.operators.sampling import joined
from gaugeframe.operators.tables import cut

#: Rows of a group whose values may lie in one buffer (8 bytes each), cells of the grid, and accuracy of the sketch.
SMALL, GRID, ACCURACY = 1 << 16, 256, 2048


def _closed_in(rows: DataFrame, ranks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells around the wanted ranks, and the ranks among them, with the rows that are left as ``_n``."""
    grid = F.percentile_approx("_x", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
    cells = joined(rows.groupBy(*by).agg(grid.alias("_grid"), F.min("_x").alias("_min"), F.max("_x").alias("_max")), ranks, by)
    # A cell more on both sides than the ranks need, as the sketch may be off by less than a cell.
    at = lambda k: F.floor(F.col(k) * GRID / F.col("_n")).cast("int")
    low = F.when(at("_low") < 1, F.col("_min")).otherwise(F.element_at("_grid", F.greatest(at("_low"), F.lit(1))))
    high = F.when(at("_high") + 3 > GRID, F.col("_max")).otherwise(F.element_at("_grid", F.least(at("_high") + 3, F.lit(GRID + 1))))
    cells = cells.select(*by, "_low", "_high", low.alias("_from"), high.alias("_to"), "_min", "_max")
    near = joined(rows, cells, by)
    count = near.groupBy(*by).agg(F.count_if(F.col("_x") < F.col("_from")).alias("_below"), F.count_if(F.col("_x").between(F.col("_from"), F.col("_to"))).alias("_inside"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_from").alias("_from"), F.first("_to").alias("_to"), F.first("_min").alias("_min"), F.first("_max").alias("_max"), F.count("*").alias("_all"))
    # Where the sketch missed the ranks after all, everything stays.
    hit = (F.col("_below") <= F.col("_low")) & (F.col("_high") < F.col("_below") + F.col("_inside"))
    kept = cut(count.select(*by, F.when(hit, F.col("_from")).otherwise(F.col("_min")).alias("_from"), F.when(hit, F.col("_to")).otherwise(F.col("_max")).alias("_to"), F.when(hit, F.col("_below")).otherwise(0).alias("_below"), F.when(hit, F.col("_inside")).otherwise(F.col("_all")).alias("_n"), "_low", "_high"))
    left = joined(rows, kept.select(*by, "_from", "_to"), by).where(F.col("_x").between(F.col("_from"), F.col("_to"))).select(*by, "_x")
    return left, kept.select(*by, (F.col("_low") - F.col("_below")).alias("_low"), (F.col("_high") - F.col("_below")).alias("_high"), "_n")


def exact_quantile(df: DataFrame, value: str, q: float, by: list[str], into: str, small: int = SMALL) -> DataFrame:
    """(by, into): the ``q`` quantile of the values of each group, between two neighbours in proportion.

    Null values don't count; a group of nulls alone has null; a null in ``by`` is a group; NaN is the largest value.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_x"))
    counts = cut(rows.groupBy(*by).agg(F.count("_x").alias("_n")))
    most = counts.agg(F.max("_n")).first()[0] or 0
    if most <= small:
        return rows.groupBy(*by).agg(F.percentile("_x", F.lit(q)).alias(into))
    at = (F.col("_n") - 1) * F.lit(float(q))
    ranks = counts.where("_n > 0").select(*by, F.floor(at).alias("_low"), F.ceil(at).alias("_high"), "_n", (at - F.floor(at)).alias("_part"))
    parts = cut(ranks.select(*by, "_part"))
    left, ranks = rows.where("_x IS NOT NULL"), ranks.drop("_part")
    while most > small:
        left, ranks = _closed_in(left, ranks, by)
        left = cut(left)
        before, most = most, ranks.agg(F.max("_n")).first()[0]
        if most > before / 2:
            break  # what is left is mostly repeats of few values
    sums = left.groupBy(*by, "_x").agg(F.count("*").alias("_c")).withColumn("_to", F.sum("_c").over(Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    sums = joined(sums, ranks.select(*by, "_low", "_high"), by)
    holds = lambda k: F.max(F.when((F.col("_to") > F.col(k)) & (F.col("_to") - F.col("_c") <= F.col(k)), F.col("_x")))
    found = joined(sums.groupBy(*by).agg(holds("_low").alias("_a"), holds("_high").alias("_b")), parts, by)
    value_of = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    return joined(counts.select(*by), found.select(*by, value_of.alias(into)), by, "left")
