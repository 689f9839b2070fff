"""Benchmark reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import reports as R

from .facts import read, rounded


def _lines(spark, d):
    return read(spark, d, "lineitem").withColumn("hit", (F.col("l_discount") >= 0.05).cast("int"))


def report_acc_split(spark, d):
    return rounded(R.by_levels(_lines(spark, d), F.col("hit"), "l_returnflag", ["l_linestatus", "l_linenumber"]))


def report_acc_wide(spark, d):
    report = R.by_levels(_lines(spark, d), F.col("hit"), "l_returnflag", ["l_linestatus"])
    return rounded(R.wide(report, ["Overall", "F", "O"]))


def report_acc_macro(spark, d):
    return rounded(R.macro(_lines(spark, d), F.col("hit"), "l_linenumber", ["l_returnflag"]))


def report_acc_two_level(spark, d):
    return rounded(R.two_level(_lines(spark, d), F.col("hit"), "l_returnflag", "l_linestatus", "l_linenumber"))


def pivot_setting_avg(spark, d):
    return rounded(R.pivot_with_average(_lines(spark, d), F.col("hit"), "l_linenumber", "l_returnflag", ["A", "N", "R"]))


def rollup_accuracy(spark, d):
    return rounded(R.tree(_lines(spark, d), F.col("hit"), "l_returnflag", "l_linestatus", "l_linenumber"))


def cube_duration_domain(spark, d):
    rows = read(spark, d, "events").where("value >= 0").withColumn("bucket", F.when(F.col("value") <= 20, "short").when(F.col("value") <= 60, "medium").otherwise("long"))
    cube = rows.withColumn("hit", (F.col("event_id") % 3 == 0).cast("int")).cube("bucket", "event_type").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))
    return rounded(cube)


def circular_all_correct(spark, d):
    groups = R.all_correct(_lines(spark, d), F.col("l_quantity") > 5, ["l_orderkey"])
    return rounded(groups.agg(F.count("*").alias("groups"), F.count_if("hit").alias("right"), F.avg(F.col("hit").cast("int")).alias("accuracy")))


def pair_all_correct(spark, d):
    groups = R.all_correct(_lines(spark, d), F.col("l_quantity") > 5, ["l_orderkey"], least=2)
    return rounded(groups.agg(F.count("*").alias("groups"), F.count_if("hit").alias("right"), F.avg(F.col("hit").cast("int")).alias("accuracy")))


def figure_question_acc(spark, d):
    return rounded(R.figure_question(_lines(spark, d), F.col("l_quantity") > 5, ["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_returnflag"]))


def rotation_hit_all_miss_all(spark, d):
    turned = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.explode(F.array(*[F.lit(r) for r in (0, 90, 180, 270)])).alias("rot"))
    return rounded(R.rotations(turned, (F.col("o_orderkey") * 31 + F.col("rot")) % 7 < 4, ["o_orderkey"], "rot", [0, 90, 180, 270], "o_orderpriority"))


def _judged(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def binary_classification_prf1(spark, d):
    return rounded(R.confusion(_judged(spark, d), F.col("quality"), 1 - F.col("toxic"), ["lang"]))


def control_group_metrics(spark, d):
    return rounded(R.against_control(_judged(spark, d), "lang", "en", F.col("quality"), 1 - F.col("toxic")))


def multi_label_explode_acc(spark, d):
    return rounded(R.multi_label(_judged(spark, d), F.col("quality") == 1, F.array("lang", "source")))


def count_error_metrics(spark, d):
    return rounded(R.count_errors(_lines(spark, d), F.col("l_quantity"), F.col("l_linenumber") * 7.0, ["l_returnflag"]))


def acc_at_threshold(spark, d):
    rows = read(spark, d, "orders").withColumn("iou", (F.col("o_orderkey") * 37 % 100) / 100.0)
    return rounded(R.at_thresholds(rows, F.col("iou"), [0.1, 0.2, 0.3, 0.4, 0.5], F.col("o_custkey") % 2 == 0))


def rec_at_threshold(spark, d):
    rows = read(spark, d, "orders").withColumn("iou", (F.col("o_orderkey") * 37 % 100) / 100.0)
    return rounded(R.at_thresholds(rows, F.col("iou"), [0.1, 0.2, 0.3, 0.4, 0.5]))


def cycle_average(spark, d):
    return rounded(R.cycles(_lines(spark, d), F.col("hit"), "l_linenumber", "l_returnflag"))


def metric_flatten(spark, d):
    table = _lines(spark, d).groupBy("l_returnflag").agg(F.avg("hit").alias("Overall"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("hit"))).alias("O"), F.avg(F.when(F.col("l_quantity") < 0, F.col("hit"))).alias("none"))
    return rounded(R.flatten_metrics(table, "l_returnflag", ["Overall", "O", "none"]))


def multi_run_summary(spark, d):
    """The last record of a (metric, seed) holds; benchmarks are never pooled."""
    rows = read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("seed"), "value", F.struct("ts", "event_id").alias("at"))
    last = rows.groupBy("event_type", "seed").agg(F.max_by("value", "at").alias("value"))
    return rounded(last.groupBy("event_type").agg(F.count("*").alias("seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (F.stddev_samp("value") / F.sqrt(F.count("*").cast("double"))).alias("sem")))


QUERIES = {
    f.__name__: f
    for f in (report_acc_split, report_acc_wide, report_acc_macro, report_acc_two_level, pivot_setting_avg, rollup_accuracy, cube_duration_domain, circular_all_correct, pair_all_correct, figure_question_acc,
              rotation_hit_all_miss_all, binary_classification_prf1, control_group_metrics, multi_label_explode_acc, count_error_metrics, acc_at_threshold, rec_at_threshold, cycle_average, metric_flatten, multi_run_summary)
}

_LINES = "lines AS (SELECT *, CAST(l_discount >= 0.05 AS INTEGER) hit FROM lineitem)"
_JUDGED = "judged AS (SELECT l.*, lang, source FROM labels l JOIN documents USING (doc_id))"
_PRF = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) accuracy"""
SQL = {
    "report_acc_split": f"""WITH {_LINES}, u AS (SELECT l_returnflag split, 'Overall' AS level, 'Overall' AS name, hit FROM lines UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus, hit FROM lines
        UNION ALL SELECT l_returnflag, 'l_linenumber', CAST(l_linenumber AS VARCHAR), hit FROM lines) SELECT split, level, name, count(*) n, round(avg(hit), 6) accuracy FROM u GROUP BY ALL""",
    "report_acc_wide": f"""WITH {_LINES} SELECT l_returnflag split, round(avg(hit), 6) "Overall", round(avg(hit) FILTER (l_linestatus = 'F'), 6) "F", round(avg(hit) FILTER (l_linestatus = 'O'), 6) "O" FROM lines GROUP BY ALL""",
    "report_acc_macro": f"WITH {_LINES}, m AS (SELECT l_returnflag, l_linenumber, avg(hit) a FROM lines GROUP BY ALL) SELECT l_returnflag, count(*) groups, round(avg(a), 6) accuracy FROM m GROUP BY ALL",
    "report_acc_two_level": f"""WITH {_LINES}, b AS (SELECT l_returnflag split, l_linestatus, l_linenumber, hit FROM lines UNION ALL SELECT 'ALL', l_linestatus, l_linenumber, hit FROM lines),
        c AS (SELECT split, l_linenumber, avg(hit) a FROM b GROUP BY ALL), e AS (SELECT DISTINCT l_linestatus, l_linenumber FROM lines), f AS (SELECT l_linestatus, count(*) k FROM e GROUP BY ALL)
        SELECT split, l_linestatus, CASE WHEN count(*) = any_value(k) THEN round(avg(a), 6) END accuracy FROM e JOIN c USING (l_linenumber) JOIN f USING (l_linestatus) GROUP BY split, l_linestatus""",
    "pivot_setting_avg": f"""WITH {_LINES}, p AS (SELECT l_linenumber, coalesce(avg(hit) FILTER (l_returnflag = 'A'), 0) "A", coalesce(avg(hit) FILTER (l_returnflag = 'N'), 0) "N", coalesce(avg(hit) FILTER (l_returnflag = 'R'), 0) "R" FROM lines GROUP BY ALL)
        SELECT l_linenumber, round("A", 6) "A", round("N", 6) "N", round("R", 6) "R", round(("A" + "N" + "R") / 3, 6) "Avg" FROM p""",
    "rollup_accuracy": f"""WITH {_LINES} SELECT l_returnflag, l_linestatus, l_linenumber, count(hit) n, CAST(sum(hit) AS DOUBLE) correct, round(avg(hit), 6) accuracy,
        CAST(3 - bit_count(CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS INTEGER)) AS INTEGER) depth FROM lines GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""",
    "cube_duration_domain": """WITH r AS (SELECT CASE WHEN value <= 20 THEN 'short' WHEN value <= 60 THEN 'medium' ELSE 'long' END bucket, event_type, CAST(event_id % 3 = 0 AS INTEGER) hit FROM events WHERE value >= 0)
        SELECT bucket, event_type, count(*) n, round(avg(hit), 6) accuracy FROM r GROUP BY CUBE (bucket, event_type)""",
    "circular_all_correct": "WITH g AS (SELECT l_orderkey, bool_and(l_quantity > 5) h FROM lineitem GROUP BY ALL) SELECT count(*) groups, count_if(h) \"right\", round(avg(CAST(h AS INTEGER)), 6) accuracy FROM g",
    "pair_all_correct": "WITH g AS (SELECT l_orderkey, bool_and(l_quantity > 5) AND count(*) >= 2 h FROM lineitem GROUP BY ALL) SELECT count(*) groups, count_if(h) \"right\", round(avg(CAST(h AS INTEGER)), 6) accuracy FROM g",
    "figure_question_acc": """WITH a AS (SELECT l_returnflag, avg(CAST(l_quantity > 5 AS INTEGER)) x FROM lineitem GROUP BY ALL), q AS (SELECT l_returnflag, l_orderkey, l_linenumber, bool_and(l_quantity > 5) h FROM lineitem GROUP BY ALL),
        f AS (SELECT l_returnflag, l_orderkey, bool_and(h) h FROM q GROUP BY ALL) SELECT l_returnflag, round(any_value(x), 6) "aAcc", (SELECT round(avg(CAST(h AS INTEGER)), 6) FROM q WHERE q.l_returnflag = a.l_returnflag) "qAcc",
        (SELECT round(avg(CAST(h AS INTEGER)), 6) FROM f WHERE f.l_returnflag = a.l_returnflag) "fAcc" FROM a GROUP BY l_returnflag""",
    "rotation_hit_all_miss_all": """WITH t AS (SELECT o_orderkey, o_orderpriority, rot, CAST((o_orderkey * 31 + rot) % 7 < 4 AS INTEGER) h FROM orders, (VALUES (0), (90), (180), (270)) v(rot)),
        i AS (SELECT o_orderkey, o_orderpriority, sum(h) s, max(h) FILTER (rot = 0) a, max(h) FILTER (rot = 90) b, max(h) FILTER (rot = 180) c, max(h) FILTER (rot = 270) e FROM t GROUP BY ALL),
        g AS (SELECT o_orderpriority AS name, count(*) total, avg(CAST(s = 4 AS INTEGER)) hit_all, avg(CAST(s = 0 AS INTEGER)) miss_all, avg(a) rate_0, avg(b) rate_90, avg(c) rate_180, avg(e) rate_270 FROM i GROUP BY ALL)
        SELECT name, total, round(hit_all, 6) hit_all, round(miss_all, 6) miss_all, round(rate_0, 6) rate_0, round(rate_90, 6) rate_90, round(rate_180, 6) rate_180, round(rate_270, 6) rate_270 FROM g UNION ALL
        SELECT 'Average', CAST(floor(avg(total)) AS BIGINT), round(avg(hit_all), 6), round(avg(miss_all), 6), round(avg(rate_0), 6), round(avg(rate_90), 6), round(avg(rate_180), 6), round(avg(rate_270), 6) FROM g""",
    "binary_classification_prf1": f"""WITH {_JUDGED}, c AS (SELECT lang, count_if(quality = 1 AND toxic = 0) tp, count_if(quality = 0 AND toxic = 0) fp, count_if(quality = 1 AND toxic = 1) fn, count_if(quality = 0 AND toxic = 1) tn FROM judged GROUP BY ALL),
        m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r FROM c)
        SELECT lang, tp, fp, fn, tn, {_PRF}, round(p, 6) "precision", round(r, 6) recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) f1 FROM m""",
    "control_group_metrics": f"""WITH {_JUDGED}, x AS (SELECT lang, quality, toxic FROM judged WHERE lang <> 'en' UNION ALL SELECT o.lang, j.quality, j.toxic FROM judged j, (SELECT DISTINCT lang FROM judged WHERE lang <> 'en') o WHERE j.lang = 'en'),
        c AS (SELECT lang, count_if(quality = 1 AND toxic = 0) tp, count_if(quality = 0 AND toxic = 0) fp, count_if(quality = 1 AND toxic = 1) fn, count_if(quality = 0 AND toxic = 1) tn FROM x GROUP BY ALL)
        SELECT lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 FROM c""",
    "multi_label_explode_acc": f"WITH {_JUDGED} SELECT label, count(*) total, CAST(sum(quality) AS BIGINT) hits, round(sum(quality) / count(*), 6) rate FROM (SELECT quality, unnest([lang, source, 'Overall']) label FROM judged) GROUP BY ALL",
    "count_error_metrics": """WITH e AS (SELECT l_returnflag, least(abs(l_linenumber * 7.0 - l_quantity), greatest(2 * l_quantity, 100)) e FROM lineitem)
        SELECT l_returnflag, round(avg(CAST(e = 0 AS INTEGER)), 6) acc, round(avg(CAST(e <= 1 AS INTEGER)), 6) oboa, round(avg(e), 6) mae, round(sqrt(avg(e * e)), 6) rmse FROM e GROUP BY ALL""",
    "acc_at_threshold": """WITH r AS (SELECT t, avg(CAST((o_orderkey * 37 % 100) / 100.0 >= t AND o_custkey % 2 = 0 AS INTEGER)) a FROM orders, (VALUES (0.1), (0.2), (0.3), (0.4), (0.5)) v(t) GROUP BY ALL)
        SELECT CAST(t AS VARCHAR) threshold, round(a, 6) rate FROM r UNION ALL SELECT 'mean', round(avg(a), 6) FROM r""",
    "rec_at_threshold": """WITH r AS (SELECT t, avg(CAST((o_orderkey * 37 % 100) / 100.0 >= t AS INTEGER)) a FROM orders, (VALUES (0.1), (0.2), (0.3), (0.4), (0.5)) v(t) GROUP BY ALL)
        SELECT CAST(t AS VARCHAR) threshold, round(a, 6) rate FROM r UNION ALL SELECT 'mean', round(avg(a), 6) FROM r""",
    "cycle_average": f"WITH {_LINES}, p AS (SELECT l_linenumber, l_returnflag, avg(hit) m FROM lines GROUP BY ALL) SELECT l_returnflag, round(sum(m) / (SELECT count(DISTINCT l_linenumber) FROM lineitem), 6) accuracy FROM p GROUP BY ALL",
    "metric_flatten": f"""WITH {_LINES}, t AS (SELECT l_returnflag s, avg(hit) a, avg(hit) FILTER (l_linestatus = 'O') o FROM lines GROUP BY ALL)
        SELECT 'split=' || s || '|Overall' AS "key", round(a, 6) "value" FROM t UNION ALL SELECT 'split=' || s || '|O', round(o, 6) FROM t WHERE o IS NOT NULL""",
    "multi_run_summary": """WITH l AS (SELECT event_type, user_id % 3 seed, arg_max(value, (ts, event_id)) v FROM events GROUP BY ALL)
        SELECT event_type, count(*) seeds, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, round(stddev_samp(v) / sqrt(count(*)), 6) sem FROM l GROUP BY ALL""",
}
