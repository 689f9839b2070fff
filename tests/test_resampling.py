"""Draws as matrices, against rows exploded by draw and hashed by Spark."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import resampling, scores


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), None if i % 17 == 0 else rng.random(), rng.random()) for i in range(700)]
    return spark.createDataFrame([*rows, *rows[:9]], "id long, c string, s double, t double")


def exploded(table, draws, seed):
    h = F.xxhash64(F.xxhash64("id"), "d", F.lit(seed))
    return table.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("h", h)


def test_hashes_are_those_of_spark(spark):
    ids = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789], np.int64)
    rows = spark.createDataFrame([(int(x), d) for x in ids for d in range(5)], "i long, d int")
    want = [r.h for r in rows.select(F.xxhash64("i", "d", F.lit(-7)).alias("h")).collect()]
    assert resampling.hash_matrix(ids, np.arange(5), -7).view(np.int64).ravel().tolist() == want


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_interval_equals_exploded_rows(spark, table, monkeypatch, held):
    monkeypatch.setattr(resampling, "HELD", held)
    cdf = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    sums = {}
    for r in exploded(table.where("s IS NOT NULL"), 40, 3).collect():
        k = sum(r.h % (1 << 40) / float(1 << 40) >= x for x in cdf)
        at = sums.setdefault((r.d, r.c), [0, 0.0])
        at[0], at[1] = at[0] + k, at[1] + k * r.s
    means = [np.mean([t / n for (d, _), (n, t) in sums.items() if d == draw and n]) for draw in range(40)]
    got = scores.bootstrap_ci(table.repartition(5), "s", "c", draws=40, seed=3, key="id").first()
    assert got.low == pytest.approx(np.percentile(means, 2.5)) and got.high == pytest.approx(np.percentile(means, 97.5))


def test_flips_equal_exploded_rows(spark, table):
    sums = np.zeros(31)
    for r in exploded(table.where("s IS NOT NULL"), 31, 0).collect():
        sums[r.d] += (r.s - r.t) * (1 if r.d == 0 or r.h % 2 == 0 else -1)
    got = scores.permutation_p(table, "s", "t", draws=30, key="id").first()
    assert got.observed == pytest.approx(abs(sums[0])) and got.p == pytest.approx(np.mean(abs(sums[1:]) >= abs(sums[0]) - 1e-12))


def test_what_leaves_a_task_is_a_row_for_each_draw(spark, table):
    sums = resampling.sums_by_draw(table, F.lit("x"), F.col("s"), F.xxhash64("id"), 20, 0, resampling.poisson)
    assert sums.count() == 20
    assert resampling.sums_by_draw(table.limit(0), F.lit("x"), F.col("s"), F.xxhash64("id"), 20, 0, resampling.poisson).count() == 0
    none = table.limit(0)
    assert tuple(scores.bootstrap_ci(none, "s").first()) == (None, None) and tuple(scores.permutation_p(none, "s", "t").first()) == (None, None)
