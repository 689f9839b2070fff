"""Checked and chained joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import joins as J
from gaugeframe.operators import reports

from .facts import read, rounded


def asserted_join(spark, d):
    joined = J.asserted(read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_totalprice"), read(spark, d, "customer"), ["c_custkey"])
    return rounded(joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)


def receipt_star_join(spark, d):
    """Orders, customers, nations and regions, each link asserted."""
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    own = J.asserted(orders, read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    placed = J.asserted(own, read(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"])
    return J.asserted(placed, read(spark, d, "region"), ["r_regionkey"]).groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"))


def chained_left_join(spark, d):
    key = F.col("o_custkey").alias("k")
    part = lambda s: read(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(key).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return J.chained(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), {s: part(s) for s in ("F", "O", "P")}, ["k"])


def hierarchy_means(spark, d):
    parents = read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return rounded(J.up_hierarchy(read(spark, d, "customer"), "c_nationkey", F.col("c_acctbal"), parents, "n_regionkey"), 4)


def grid_completeness(spark, d):
    found = read(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment")
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.grid_difference(found, nations, read(spark, d, "customer").select("c_mktsegment"))


def digest_semi_join(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    wanted = rows.groupBy("p_brand").agg(F.min("p_type").alias("p_type")).select(F.sha2(F.concat_ws("\0", "p_brand", "p_type"), 256).alias("digest"))
    return J.by_digest(rows, wanted, ["p_brand", "p_type"]).select("p_partkey")


def identity_fold_conflicts(spark, d):
    a = read(spark, d, "orders").withColumn("fold", F.col("o_custkey") % 3)
    b = read(spark, d, "lineitem").withColumn("fold", F.col("l_partkey") % 3)
    return J.fold_conflicts((a, F.array(F.col("o_custkey")), "fold"), (b, F.array("l_partkey", "l_suppkey"), "fold"))


def first_occurrence(spark, d):
    return J.first_seen(read(spark, d, "events"), ["user_id", "event_type"], "event_id")


def variant_consistency(spark, d):
    """Groups of four variants that are all right, over a quarter of the rows."""
    rows = read(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("g"), (F.col("o_custkey") % 5 > 0).alias("h"))
    groups = reports.all_correct(rows, F.col("h"), ["g"], least=4)
    return rounded(groups.agg(F.count_if("hit").alias("right"), F.sum("rows").alias("rows"), (F.count_if("hit") / (F.sum("rows") / 4)).alias("accuracy")))


def map_scores(spark, d):
    m = lambda *xs: F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(*xs))
    rows = read(spark, d, "part").select("p_partkey", J.map_scores(m(F.col("p_size") % 3, F.col("p_size") % 2), m(F.col("p_partkey") % 3, F.col("p_partkey") % 2)).alias("s"))
    return rounded(rows.select("p_partkey", "s.*"))


def json_keyed_rank(spark, d):
    return read(spark, d, "nation").select("n_nationkey", J.json_rank(7, F.col("n_name")).alias("rank"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

SQL = {
    "asserted_join": "SELECT c_mktsegment, count(*) n, round(avg(o_totalprice), 4) mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "receipt_star_join": "SELECT r_name, o_orderstatus, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "chained_left_join": "SELECT c_custkey k, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) \"n_{s}\", max(o_orderkey) FILTER (o_orderstatus = '{s}') \"last_{s}\"" for s in "FOP") + " FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "hierarchy_means": """WITH m AS (SELECT c_nationkey, avg(c_acctbal) m FROM customer GROUP BY 1) SELECT n_regionkey, count(*) nodes, round(avg(m), 4) mean FROM m LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_nationkey = c_nationkey GROUP BY 1""",
    "grid_completeness": """WITH f AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000), g AS (SELECT n_nationkey c_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer))
        SELECT *, 'missing' status FROM (FROM g EXCEPT FROM f) UNION ALL SELECT *, 'extra' FROM (FROM f EXCEPT FROM g)""",
    "digest_semi_join": "SELECT p_partkey FROM part SEMI JOIN (SELECT p_brand, min(p_type) p_type FROM part GROUP BY 1) USING (p_brand, p_type)",
    "identity_fold_conflicts": """WITH e AS (SELECT o_custkey i, o_custkey % 3 f FROM orders UNION ALL SELECT l_partkey, l_partkey % 3 FROM lineitem UNION ALL SELECT l_suppkey, l_partkey % 3 FROM lineitem)
        SELECT i "identity", count(DISTINCT f) folds FROM e GROUP BY 1 HAVING folds > 1""",
    "first_occurrence": "SELECT user_id, event_type, min(event_id) \"first\" FROM events GROUP BY ALL",
    "variant_consistency": "WITH g AS (SELECT o_orderkey // 4 g, bool_and(o_custkey % 5 > 0) AND count(*) >= 4 h, count(*) n FROM orders GROUP BY 1) SELECT count_if(h) \"right\", CAST(sum(n) AS BIGINT) \"rows\", round(count_if(h) / (sum(n) / 4), 6) accuracy FROM g",
    "map_scores": """WITH s AS (SELECT p_partkey, CAST(p_size % 3 = p_partkey % 3 AS INTEGER) + CAST(p_size % 2 = p_partkey % 2 AS INTEGER) n FROM part) SELECT p_partkey, n = 2 equal, n / 2 jaccard, n / 2 recall FROM s""",
    "json_keyed_rank": "SELECT n_nationkey, sha256('[7,' || to_json(n_name) || ']') AS \"rank\" FROM nation",
}
