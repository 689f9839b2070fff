"""Facts derived from the test tables with integer arithmetic only, in Spark and as a SQL prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS, SEEDS, BASELINE = ["baseline", "m1", "m2", "m3"], [42, 43, 44], "baseline"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, benchmark, family, capability, model, seed, hit: a row for every order, model and seed."""
    runs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("mid"), F.lit(s).alias("seed")) for i, m in enumerate(MODELS) for s in SEEDS])
    cap = F.col("o_custkey") % 25
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("benchmark"),
        F.concat(F.lit("F"), (cap % 3).cast("string")).alias("family"), F.concat(F.lit("C"), cap.cast("string")).alias("capability"), F.explode(runs).alias("r"),
    )
    hit = ((F.col("uid") * 7919 + F.col("r.mid") * 104729 + F.col("r.seed") * 1299709) % 97) < (48 + F.col("r.mid"))
    return rows.select("uid", "benchmark", "family", "capability", "r.model", "r.seed", hit.cast("int").alias("hit"))


HITS = """
runs AS (SELECT * FROM (VALUES ('baseline', 0), ('m1', 1), ('m2', 2), ('m3', 3)) m(model, mid), (VALUES (42), (43), (44)) s(seed)),
hits AS (SELECT o_orderkey uid, o_orderpriority benchmark, 'F' || ((o_custkey % 25) % 3) family, 'C' || (o_custkey % 25) capability, model, seed,
  CAST(((o_orderkey * 7919 + mid * 104729 + seed * 1299709) % 97) < 48 + mid AS INTEGER) hit FROM orders, runs),
noded AS (
  SELECT uid, model, seed, hit, scope, level, CASE level WHEN 'overall' THEN 'overall' WHEN 'family' THEN family ELSE capability END node
  FROM hits, (VALUES ('overall'), ('family'), ('capability')) l(level), LATERAL (SELECT unnest(['ALL', benchmark]) scope)),
cells AS (SELECT scope, level, node, model, seed, sum(hit) correct, count(*) total, 100.0 * sum(hit) / count(*) accuracy FROM noded GROUP BY ALL),
per_seed AS (SELECT c.*, c.accuracy - b.accuracy gain FROM cells c JOIN cells b USING (scope, level, node, seed) WHERE b.model = 'baseline'),
summaries AS (SELECT scope, level, node, model, count(accuracy) seeds, avg(accuracy) accuracy_mean, stddev_samp(accuracy) accuracy_std,
  stddev_samp(accuracy) / sqrt(count(accuracy)) accuracy_sem, avg(gain) gain_mean, stddev_samp(gain) gain_std, stddev_samp(gain) / sqrt(count(gain)) gain_sem
  FROM per_seed GROUP BY ALL),
questions AS (SELECT scope, level, node, model, uid, sum(hit) h FROM noded GROUP BY ALL),
differences AS (SELECT a.scope, a.level, a.node, a.model, a.uid, CAST(a.h - b.h AS BIGINT) d FROM questions a JOIN questions b USING (scope, level, node, uid)
  WHERE a.model <> 'baseline' AND b.model = 'baseline'),
counts AS (SELECT scope, level, node, model, count_if(abs(d) = 1) n1, count_if(abs(d) = 2) n2, count_if(abs(d) = 3) n3, CAST(sum(d) AS BIGINT) difference, count(*) questions
  FROM differences GROUP BY ALL)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, as both engines sum in their own order; a negative zero becomes zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t in ("double", "float")})
