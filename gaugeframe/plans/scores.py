"""Further benchmark scores over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import pytext as P
from gaugeframe.functions.numeric import bucket, geo_proximity, loss_weight
from gaugeframe.operators import scores as S

from .facts import hits, read, rounded


def natural_group_scores(spark, d):
    bit = lambda k: (F.col("o_orderkey") * k % 11 < 6).cast("int")
    rows = read(spark, d, "orders").select("o_orderkey", bit(3).alias("a"), bit(5).alias("b"), bit(7).alias("c"), bit(13).alias("e"))
    return rounded(S.natural_groups(rows, "o_orderkey", "a", "b", "c", "e"))


def paired_answer_scores(spark, d):
    rows = read(spark, d, "orders").select("o_orderpriority", F.floor(F.col("o_orderkey") / 3).alias("image"), "o_orderkey", (F.col("o_custkey") % 2).alias("score"))
    return rounded(S.paired_answers(rows, "o_orderpriority", "image", "o_orderkey", "score"))


def multi_step_mastery(spark, d):
    ok = lambda k, m: F.col("o_orderkey") * k % 10 < m
    rows = read(spark, d, "orders").select(ok(3, 7).alias("s1"), ok(7, 6).alias("s2"), F.when(F.col("o_custkey") % 2 == 0, ok(9, 8)).alias("s3"), ok(11, 5).alias("whole"))
    return rounded(S.mastery(rows, ["s1", "s2", "s3"], "whole"))


def weighted_field_scores(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("task"), "l_orderkey", (F.col("l_quantity") / 50 - 0.05).alias("score"), (F.col("l_linenumber") * 1.0).alias("weight"))
    return rounded(S.weighted_fields(rows, "task", "l_orderkey", "score", "weight"))


def smallest_field_scores(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("task"), "l_orderkey", (F.col("l_quantity") / 50 - 0.05).alias("score"), (F.col("l_linenumber") * 1.0).alias("weight"))
    return rounded(S.weighted_fields(rows, "task", "l_orderkey", "score", "weight", smallest=True))


def count_penalty_scores(spark, d):
    rows = read(spark, d, "lineitem").withColumn("s", S.count_penalty(F.col("l_linenumber"), (F.col("l_quantity") % 7 + 1), F.lit(8)))
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("s").alias("score")))


def category_counters(spark, d):
    groups = {"first": ["1-URGENT", "2-HIGH"], "rest": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    return rounded(S.counters(read(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey") % 3 == 0, groups))


def most_common(spark, d):
    return S.first_mode(read(spark, d, "events"), "user_id", "event_id")


def duration_buckets(spark, d):
    rows = read(spark, d, "events").withColumn("b", bucket(F.col("value"), [10, 20, 60], ["0-10", "10-20", "20-60", "60+"]))
    return rounded(rows.groupBy("b").agg(F.count("*").alias("n"), F.avg(S.ratio_of_least(F.col("value"), F.col("value") / 2 + 10)).alias("crr"), F.avg(loss_weight(F.floor("value"))).alias("weight")))


def bootstrap_interval(spark, d):
    rows = hits(spark, d).where("model = 'm3'").groupBy("uid", "family").agg(F.avg("hit").alias("score"))
    return rounded(S.bootstrap_ci(rows, "score", "family", draws=100, key="uid"), 4)


def permutation_test(spark, d):
    rows = hits(spark, d).groupBy("uid").pivot("model", ["baseline", "m3"]).agg(F.sum("hit"))
    return rounded(S.permutation_p(rows, "m3", "baseline", draws=100, key="uid"), 4)


def stream_groups(spark, d):
    drawn = S.weighted_draws(read(spark, d, "orders").select("o_orderkey"), "group", {"i2i": 1.0, "i2t": 3.0}, "o_orderkey")
    return drawn.groupBy("group").agg(F.count("*").alias("n"))


def geo_scores(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", geo_proximity((F.col("c_custkey") % 80) * 1.0, (F.col("c_custkey") % 170) * 1.0, (F.col("c_custkey") % 80) + 0.5, (F.col("c_custkey") % 170) + 0.25).alias("proximity"))
    return rounded(rows)


def caption_cider(spark, d):
    rows = read(spark, d, "benchmark")
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.concat(F.col("text")).alias("other"))
    mixed = rows.join(other, "item_id").withColumn("found", F.concat_ws(" ", "text", "other"))
    return rounded(S.corpus_cider(mixed, "item_id", "text", "found"), 4)


def spoken_numbers(spark, d):
    """F19 over parts, each of which says a number in one of six ways."""
    said = F.element_at(F.array(*map(F.lit, ["there are two", "twenty one of them", "one or 2", "no number", "three hundred and five", "12"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    said = F.concat(said, F.when(F.col("p_partkey") % 6 == 3, F.concat(F.lit(" "), F.col("p_name"))).otherwise(""))
    return read(spark, d, "part").select("p_partkey", P.column(P.spoken_number, "int", said).alias("number"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_FIELDS = "f AS (SELECT l_suppkey % 40 task, l_orderkey, l_quantity / 50 - 0.05 s, l_linenumber w FROM lineitem WHERE l_quantity / 50 - 0.05 >= 0), i AS (SELECT task, l_orderkey, {one} x FROM f GROUP BY ALL), t AS (SELECT task, avg(x) x FROM i GROUP BY 1) SELECT count(*) tasks, round(avg(x), 6) macro, (SELECT round(avg(x), 6) FROM i) micro FROM t"
SQL = {
    "spoken_numbers": "SELECT p_partkey, [2, 21, NULL, NULL, 305, 12][p_partkey % 6 + 1] number FROM part",
    "caption_cider": r"""WITH p AS (SELECT a.item_id, regexp_split_to_array(lower(a.text), '\s+') t, regexp_split_to_array(lower(a.text || ' ' || b.text), '\s+') f FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
        s AS (SELECT item_id, 1 side, t w FROM p UNION ALL SELECT item_id, 2, f FROM p), g AS (SELECT item_id, side, n, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT item_id, side, n, w, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) i FROM s, (VALUES (1), (2), (3), (4)) t(n))),
        c AS (SELECT item_id, n, g, count_if(side = 1) a, count_if(side = 2) b FROM g GROUP BY ALL), d AS (SELECT n, g, count_if(a > 0) df FROM c GROUP BY ALL), x AS (SELECT item_id, n, a * ln((SELECT count(*) FROM p) / CAST(greatest(df, 1) AS DOUBLE)) a, b * ln((SELECT count(*) FROM p) / CAST(greatest(df, 1) AS DOUBLE)) b FROM c JOIN d USING (n, g)),
        o AS (SELECT item_id, n, coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0) c FROM x GROUP BY ALL) SELECT item_id, round(10 * avg(c), 4) cider FROM o GROUP BY 1""",
    "natural_group_scores": """WITH r AS (SELECT o_orderkey * 3 % 11 < 6 a, o_orderkey * 5 % 11 >= 6 b, o_orderkey * 7 % 11 >= 6 c, o_orderkey * 13 % 11 < 6 e FROM orders)
        SELECT round(sum(CAST(a AND b AS INTEGER) + CAST(c AND e AS INTEGER)) / (2 * count(*)), 6) "Q_Acc", round(sum(CAST(a AND c AS INTEGER) + CAST(b AND e AS INTEGER)) / (2 * count(*)), 6) "I_Acc",
        round(sum(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(e AS INTEGER)) / (4 * count(*)), 6) "Acc", round(avg(CAST(a AND b AND c AND e AS INTEGER)), 6) "G_Acc" FROM r""",
    "paired_answer_scores": """WITH r AS (SELECT o_orderpriority, o_orderkey // 3 image, o_orderkey, o_custkey % 2 s FROM orders), p AS (SELECT o_orderpriority, image, sum(s) t, count(s) n, list(s ORDER BY o_orderkey) l FROM r GROUP BY ALL),
        g AS (SELECT o_orderpriority, 100 * sum(t) / sum(n) acc, 100 * avg(CASE WHEN len(l) >= 2 THEN l[1] * l[2] END) plus FROM p GROUP BY 1) SELECT o_orderpriority, round(acc, 6) acc, round(plus, 6) plus, round(acc + plus, 6) score FROM g""",
    "multi_step_mastery": """WITH r AS (SELECT o_orderkey * 3 % 10 < 7 a, o_orderkey * 7 % 10 < 6 b, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 9 % 10 < 8 END c, o_orderkey * 11 % 10 < 5 w FROM orders),
        s AS (SELECT a AND b AND coalesce(c, true) alls, a OR b OR coalesce(c, false) anys, w FROM r), n AS (SELECT count_if(NOT anys AND w) rote_loose, count_if(NOT alls AND w) rote_strict, count_if(alls AND NOT w) inadequate,
        count_if(NOT alls AND NOT w) insufficient, count_if(anys AND w) mastery_loose, count_if(alls AND w) mastery_strict, count(*) total FROM s)
        SELECT *, round((total - 0.5 * inadequate - rote_loose - insufficient) / total, 6) score_loose, round((total - 0.5 * inadequate - rote_strict - insufficient) / total, 6) score_strict FROM n""",
    "weighted_field_scores": "WITH " + _FIELDS.format(one="sum(s * w) / sum(w)"),
    "smallest_field_scores": "WITH " + _FIELDS.format(one="min(s)"),
    "count_penalty_scores": """WITH e AS (SELECT l_returnflag, abs(l_quantity % 7 + 1 - l_linenumber) e, greatest(l_linenumber - 1, 8 - l_linenumber, 1) m FROM lineitem)
        SELECT l_returnflag, round(avg(CASE WHEN e = 0 THEN 100 ELSE greatest(0, 100 * (1 - 0.5 * sqrt(e / m))) END), 6) score FROM e GROUP BY 1""",
    "category_counters": """WITH n AS (SELECT count_if(o_orderkey % 3 = 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) a, count_if(o_orderkey % 3 = 0 AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')) b FROM orders)
        SELECT a AS "first", b AS rest, a + b "Final Score", round((a + b) / 10, 6) "Final Score Norm" FROM n""",
    "most_common": "SELECT user_id, count(*) n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 1",
    "duration_buckets": """SELECT CASE WHEN value <= 10 THEN '0-10' WHEN value <= 20 THEN '10-20' WHEN value <= 60 THEN '20-60' ELSE '60+' END b, count(*) n, round(avg(least(value, value / 2 + 10) / (value / 2 + 10)), 6) crr,
        round(avg(CASE WHEN floor(value) > 0 THEN 1 / sqrt(floor(value)) ELSE 0 END), 6) weight FROM events GROUP BY 1""",
    "geo_scores": """WITH p AS (SELECT c_custkey, radians(c_custkey % 80) a, radians(c_custkey % 80 + 0.5) b FROM customer), h AS (SELECT c_custkey, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(radians(0.25) / 2), 2) h FROM p)
        SELECT c_custkey, round(exp(-(2 * 6371.0088 * asin(sqrt(least(h, 1)))) / 100), 6) proximity FROM h""",
}
