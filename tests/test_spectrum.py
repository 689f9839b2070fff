"""Directions by subspace iteration against dense eigenvectors, and what is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import spectrum, vectors


def pool(spark, x, fold=lambda i: i % 3, strata=lambda i: i % 4):
    rows = [(i, fold(i), str(strata(i)), i // 2, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, fold int, task string, pair long, side string, v array<double>")


def falling(n, d, rng, by=0.85):
    axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return rng.normal(size=(n, d)) * by ** np.arange(d) @ axes


def test_iteration_finds_the_dense_directions(spark):
    x = falling(900, 80, np.random.default_rng(3))
    df = pool(spark, x)
    for block in (8, 256):  # two widenings, or one exact pass
        got = {r.held_out: r for r in spectrum.pca_by_fold(df, "v", "fold", ["task"], 3, 0.95, block=block).collect()}
        for f in range(3):
            train = [i for i in range(len(x)) if i % 3 != f]
            want = spectrum.fit_pca(x[train], [i % 4 for i in train], 0.95)
            assert got[f].k == want["k"] > 6 and got[f].rows == len(train)
            assert (got[f].captured, got[f].d_eff, got[f].first_value) == pytest.approx((want["captured"], want["d_eff"], want["values"][0]), rel=1e-7)


def test_pairs_are_projected_in_the_fold_that_holds_them_out(spark):
    x = falling(240, 40, np.random.default_rng(4))
    df = pool(spark, x, fold=lambda i: i // 2 % 3).where("id <> 7")
    got = spectrum.projected_pairs(df, "v", "fold", ["side"], 3, "pair", "side", 0.9, block=6).collect()
    assert sorted(r.pair for r in got) == [p for p in range(120) if p != 3]
    for r in got[::17]:
        train = [i for i in range(240) if i // 2 % 3 != r.fold and i != 7]
        fit = spectrum.fit_pca(x[train], [i % 2 for i in train], 0.9)
        a, b = (v @ fit["basis"] for v in x[2 * r.pair : 2 * r.pair + 2])
        cosine = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
        assert (r.cosine, r.normalised) == pytest.approx((cosine, cosine * fit["d_eff"] ** 0.5), abs=1e-6)


def test_a_pool_beyond_a_gram_matrix(spark):
    # 20,000 rows: their Gram matrix would be 3.2 GB; here a task holds 2,048 rows and blocks of 32 x 32.
    df = spark.range(20_000).select("id", (F.col("id") % 5).cast("int").alias("fold"), F.lit("t").alias("task"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda j: F.randn(7) * F.lit(0.0) + F.sin((F.col("id") + 1) * j * 0.37) / j).alias("v"))
    got = spectrum.pca_by_fold(df, "v", "fold", ["task"], 5, 0.99).collect()
    assert len(got) == 5 and all(r.rows == 16_000 and 0.99 <= r.captured <= 1 and 1 <= r.d_eff <= r.k for r in got)


def test_long_vectors_of_a_small_pool(spark):
    x = falling(30, 200, np.random.default_rng(5))
    short = vectors.narrowed(pool(spark, x), "id", "v").orderBy("id").collect()
    y = np.array([r.v for r in short])
    assert y.shape == (30, 30) and np.allclose(y @ y.T, x @ x.T)


def test_what_has_no_direction(spark):
    x = falling(24, 6, np.random.default_rng(6))
    ask = lambda df, energy=0.9: spectrum.pca_by_fold(df, "v", "fold", ["task"], 3, energy).collect()
    zero, odd = x.copy(), x.copy()
    zero[3], odd[3, 0] = 0, np.nan
    for df, what in ((pool(spark, zero), "zero vector"), (pool(spark, odd), "finite"), (pool(spark, x, strata=lambda i: i % 3), "lack a stratum"), (pool(spark, x).limit(0), "no rows")):
        with pytest.raises(ValueError, match=what):
            ask(df)
    with pytest.raises(ValueError, match="energy"):
        ask(pool(spark, x), 1.5)
    assert spectrum.kept_directions(np.array([0.5, 0.3, 0.3 - 1e-9, 1e-12]), 1.1, 0.7) == 3 and spectrum.kept_directions(np.array([0.5, 0.1]), 1.0, 0.9) is None
