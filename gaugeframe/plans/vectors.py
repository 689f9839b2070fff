"""Vector statistics over the embeddings, standing in for gradient rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import numeric as N
from gaugeframe.functions.stats import guarded_corr
from gaugeframe.operators import sampling, spectrum, vectors

from .facts import read, rounded


def _rows(spark, d):
    return read(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 5).withColumn("objective", F.when(F.col("vec_id") % 2 == 0, F.lit("i2i")).otherwise(F.lit("i2t")))


def vector_norm_summary(spark, d):
    return rounded(vectors.norm_summary(_rows(spark, d), "embedding", ["label", "objective"]))


def pair_cosine(spark, d):
    """Row 2i with row 2i + 1."""
    rows = _rows(spark, d).withColumn("pair", F.floor(F.col("vec_id") / 2))
    side = lambda o: F.max_by("embedding", F.when(F.col("objective") == o, 1))
    both = rows.groupBy("pair").agg(side("i2i").alias("a"), side("i2t").alias("b"), F.count("*").alias("n")).where("n = 2")
    return rounded(both.select("pair", N.cosine(F.col("a"), F.col("b")).alias("cosine")))


def gram_matrix(spark, d):
    """V1 over the mean vectors of all strata."""
    means = vectors.mean_vectors(_rows(spark, d), "embedding", ["label", "objective"])
    return rounded(vectors.gram(means.withColumn("key", F.concat_ws(":", "objective", F.col("label").cast("string"))), "key", "embedding"))


def label_mean_alignment(spark, d):
    means = vectors.mean_vectors(_rows(spark, d), "embedding", ["label", "objective"])
    sources = means.where("objective = 'i2i'").select(F.col("label").alias("source"), "embedding")
    targets = means.where("objective = 'i2t'").select(F.col("label").alias("target"), "embedding")
    return rounded(vectors.alignment(sources, targets, "embedding"))


def left_join_missing_alignment(spark, d):
    """Every transfer cell is kept, alignment or not; then the mean per target."""
    cells = read(spark, d, "orders").groupBy((F.col("o_custkey") % 12).cast("int").alias("source"), (F.col("o_orderkey") % 10).cast("int").alias("target")).agg(F.avg("o_totalprice").alias("gain"))
    joined = cells.join(label_mean_alignment(spark, d).select(F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), "alignment"), ["source", "target"], "left")
    return rounded(joined.groupBy("target").agg(F.count("*").alias("cells"), F.count("alignment").alias("aligned"), F.avg("gain").alias("gain"), F.avg("alignment").alias("alignment")), 4)


def pearson_spearman(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.floor(F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 100).alias("y"))
    ranked = sampling.average_rank(sampling.average_rank(rows, "x", "rx", ["g"]), "y", "ry", ["g"])
    return rounded(ranked.groupBy("g").agg(F.count("*").alias("n"), guarded_corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("pearson"), guarded_corr(F.col("rx"), F.col("ry")).alias("spearman")))


def pca_energy_folds(spark, d):
    return spectrum.pca_by_fold(_rows(spark, d), "embedding", "fold", ["label", "objective"], 5)


def minibatch_alignment(spark, d):
    rows = _rows(spark, d).withColumn("task", F.col("label") % 4).withColumn("tokens", F.col("vec_id") % 17 + 1)
    return vectors.minibatch_alignment(rows, "embedding", "task", "objective", "fold", "tokens", "vec_id")


def sketch_dot_products(spark, d):
    """V7: the sketch's dot products against the true ones."""
    rows = _rows(spark, d).withColumn("s", vectors.count_sketch(F.col("embedding"), 32))
    return rows.select("vec_id", F.round(N.norm(F.col("embedding")), 4).alias("norm"), F.round(N.norm(F.col("s")), 4).alias("sketched"))


def unit_rows(spark, d):
    rows = _rows(spark, d).select("vec_id", F.posexplode(N.unit(F.col("embedding"))).alias("i", "x"))
    return rounded(rows.groupBy("vec_id").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.max("x").alias("largest")))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_CELLS = "cells AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'i2i' ELSE 'i2t' END objective, generate_subscripts(embedding, 1) i, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings)"
_ALIGN = f"""{_CELLS}, means AS (SELECT label, objective, i, avg(x) x FROM cells GROUP BY ALL),
  align AS (SELECT a.label source, b.label target, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) alignment FROM means a JOIN means b USING (i) WHERE a.objective = 'i2i' AND b.objective = 'i2t' GROUP BY ALL)"""
SQL = {
    "vector_norm_summary": f"""WITH {_CELLS}, n AS (SELECT vec_id, label, objective, sqrt(sum(x * x)) n FROM cells GROUP BY ALL)
        SELECT label, objective, count(*) "rows", round(avg(n), 6) mean_norm, round(median(n), 6) median_norm, round(sqrt(avg(n * n)), 6) rms_norm FROM n GROUP BY ALL""",
    "pair_cosine": f"WITH {_CELLS} SELECT a.vec_id // 2 pair, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) cosine FROM cells a JOIN cells b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0 GROUP BY 1",
    "gram_matrix": f"WITH {_CELLS}, m AS (SELECT objective || ':' || label k, i, avg(x) x FROM cells GROUP BY ALL) SELECT a.k AS i, b.k AS j, round(sum(a.x * b.x), 6) dot FROM m a JOIN m b ON a.i = b.i AND a.k <= b.k GROUP BY a.k, b.k",
    "label_mean_alignment": f"WITH {_ALIGN} SELECT source, target, round(alignment, 6) alignment FROM align",
    "left_join_missing_alignment": f"""WITH {_ALIGN}, c AS (SELECT o_custkey % 12 source, o_orderkey % 10 target, avg(o_totalprice) gain FROM orders GROUP BY ALL)
        SELECT CAST(target AS INTEGER) target, count(*) cells, count(alignment) aligned, round(avg(gain), 4) gain, round(avg(round(alignment, 6)), 4) alignment FROM c LEFT JOIN align USING (source, target) GROUP BY ALL""",
    "pearson_spearman": """WITH r AS (SELECT o_orderpriority g, CAST(floor(o_totalprice / 1000) AS DOUBLE) x, CAST(o_custkey % 100 AS DOUBLE) y FROM orders),
        k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 ry FROM r)
        SELECT g, count(*) n, round(corr(x, y), 6) pearson, round(corr(rx, ry), 6) spearman FROM k GROUP BY 1""",
    "unit_rows": f"WITH {_CELLS}, n AS (SELECT vec_id, sqrt(sum(x * x)) n FROM cells GROUP BY ALL) SELECT vec_id, round(sum(x * x / n / n), 6) square, round(max(x / n), 6) largest FROM cells JOIN n USING (vec_id) GROUP BY 1",
}
