"""Validation, sampling, reshaping, intervals, receipts, batching and conversations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeframe.functions import hashing as H
from gaugeframe.functions import numeric as N
from gaugeframe.operators import batching, dependencies, overlaps, receipts, reshape, sampling, validation

from .facts import read, rounded


def coverage_missing_extra(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").select((F.col("doc_id") + 7).alias("doc_id"))
    return validation.coverage(docs, labels, ["doc_id"])


def question_drift(spark, d):
    left = read(spark, d, "documents").select("doc_id", "lang", "source")
    right = left.select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.lit(None)).otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 70 == 0, F.lit("moved")).otherwise(F.col("source")).alias("source"))
    return validation.drift(left, right, ["doc_id"], ["lang", "source"])


def fold_crossing(spark, d):
    return validation.crossing(read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("identity"), (F.col("o_custkey") % 7).alias("fold")), "identity", "fold")


def conversation_validation(spark, d):
    return validation.conversations(read(spark, d, "conversations"))


def conversation_segments(spark, d):
    marked = read(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"\. ", ". <image> "))
    parts = batching.segments(marked)
    return parts.groupBy("conv_id", "kind", "loss").agg(F.count("*").alias("parts"), F.sum(F.coalesce(F.length(F.trim("value")), F.lit(0))).alias("chars"))


def history_accumulation(spark, d):
    """What stands before each turn, as counts of turns and characters: sums, not copies of the history."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = read(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.count("*").over(w).alias("turns_before"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("chars_before"))


def hash_topk(spark, d):
    return sampling.hash_top_k(read(spark, d, "documents").select("doc_id"), "doc_id", 25, 20260826)


def hash_topk_per_group(spark, d):
    return sampling.hash_top_k(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 10, 42, ["o_orderpriority"])


def fold_assignment(spark, d):
    return sampling.fold_of_rank(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, 20260826)


def occurrence_counter(spark, d):
    return sampling.occurrence(read(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "repeat_index")


def ordered_uid_hash(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(H.ordered_digest(F.col("n_nationkey"), F.col("n_name")).alias("digest"))


def stable_seeds(spark, d):
    return read(spark, d, "nation").select("n_nationkey", H.rank_digest(7, F.col("n_name")).alias("rank"), H.stable_seed(7, F.col("n_name")).alias("seed"))


def connected_components_folds(spark, d):
    """G1: customers linked by orders of the same price in whole units."""
    edges = read(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("a"), F.concat(F.lit("p"), F.floor("o_totalprice")).alias("b"))
    found = sampling.components(edges, "a", "b")
    return found.groupBy("root").agg(F.count("*").alias("members"))


def strided_shards(spark, d):
    return read(spark, d, "orders").groupBy(sampling.strided(F.col("o_orderkey"), 7).alias("shard")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


def contiguous_shards(spark, d):
    rows = read(spark, d, "documents")
    shard = sampling.contiguous(F.col("doc_id"), rows.count(), 7)
    return rows.withColumn("shard", shard).where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def circular_variants(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.col("p_size").cast("string").alias("C"), F.col("p_name").alias("D"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("answer"))
    return reshape.circular_variants(rows, ["A", "B", "C", "D"], "answer", "index")


def tagged_union(spark, d):
    both = reshape.tagged_union({"customer": read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), "supplier": read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))}, "origin")
    return both.groupBy("origin", "segment").agg(F.count("*").alias("rows"), F.sum("key").alias("keys"))


def missing_grid(spark, d):
    return reshape.missing_grid(read(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), "user_id", "day")


def running_curriculum(spark, d):
    """Three phases over the orders, switching on how many of status F were drawn before."""
    rows = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("target"))
    run = reshape.offset_running_sum(rows, F.floor(F.col("o_orderkey") / 1000), ["o_orderkey"], F.col("target"), "drawn")
    return run.withColumn("phase", batching.phase(F.col("drawn") - F.col("target"), [1000, 2500, 0])).groupBy("phase").agg(F.count("*").alias("rows"), F.sum("target").alias("targets"), F.min("o_orderkey").alias("first"))


def budget_round_up(spark, d):
    return read(spark, d, "part").select("p_partkey", batching.budget_rounded(F.col("p_size"), 8).cast("long").alias("samples"))


def sequence_packing(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("worker"), batching.tokens_of(F.col("n_chars"), F.lit(1)).alias("n"))
    return batching.packed(rows, "worker", "doc_id", "doc_id", "n").groupBy("worker", "pack").agg(F.count("*").alias("samples"), F.sum("tokens").alias("tokens"))


def _spans(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, d, "events").select("user_id", "event_id", "event_type", start.alias("start"), (start + (F.floor(F.col("value")) * 60_000_000).cast("long")).alias("end"))


def interval_merge(spark, d):
    return reshape.merge_intervals(_spans(spark, d), ["user_id"], "start", "end")


def interval_iou(spark, d):
    """what clicks and views of a user cover in common, from rows."""
    spans = lambda kind: _spans(spark, d).where(F.col("event_type") == kind).select("user_id", "start", "end")
    return rounded(overlaps.sets_iou(spans("click"), spans("view"), ["user_id"]))


def nearest_spans(spark, d):
    """For each click the view of the same user that it shares most with."""
    spans = lambda kind: _spans(spark, d).where(F.col("event_type") == kind).select("user_id", "event_id", "start", "end")
    return rounded(overlaps.nearest(spans("click"), spans("view"), ["user_id"], "event_id"))


def box_iou(spark, d):
    c = F.col
    a = [c("l_quantity"), c("l_linenumber") * 1.0, c("l_quantity") + 10, c("l_linenumber") + 5.0]
    b = [c("l_linenumber") * 5.0, c("l_linenumber") + 1.0, c("l_linenumber") * 5.0 + 12, c("l_linenumber") + 4.0]
    rows = read(spark, d, "lineitem").select("l_returnflag", N.box_iou(a, b).alias("iou"), N.centre_inside(a, b).alias("inside"), N.span_iou([a[0], a[2]], [b[0], b[2]]).alias("span"))
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("iou").alias("iou"), F.avg((F.col("iou") >= 0.5).cast("int")).alias("precision"), F.avg(F.col("inside").cast("int")).alias("inside"), F.avg("span").alias("span")))


def status_latest_wins(spark, d):
    return receipts.latest_status(read(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


def diagnostics_counts(spark, d):
    log = F.when(F.col("event_type") == "error", F.concat(F.lit("Exact matching fallback: "), F.col("event_id").cast("string"))).when(F.col("event_id") % 11 == 0, F.lit("Unresolved LLM judge response."))
    return receipts.diagnostics(read(spark, d, "events"), log)


def remaining_work(spark, d):
    return receipts.remaining(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


def dependency_closure(spark, d):
    """Each order waits for the customer's order before it, by date and key."""
    rows = read(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return dependencies.ancestors(rows.select("o_orderkey", before.alias("before")), "o_orderkey", "before")


def json_normalize_group(spark, d):
    """A26, U14"""
    rows = read(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rounded(rows.groupBy("event_type", (F.col("k") % 5).alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


def event_tumbling_window(spark, d):
    """An extension: hourly sums."""
    rows = read(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(rows.select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total"))


def event_sessions(spark, d):
    """An extension: sessions of a user that end after 30 minutes without an event."""
    rows = read(spark, d, "events").groupBy(F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start"), "n")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_SPANS = "spans AS (SELECT user_id, event_id, event_type, epoch_us(ts) s, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 e FROM events)"
_ISLANDS = """o AS (SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM {t}),
  i AS (SELECT *, sum(CAST(coalesce(s > reach, true) AS INTEGER)) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM o)"""
SQL = {
    "coverage_missing_extra": "WITH l AS (SELECT doc_id + 7 doc_id FROM labels) SELECT doc_id, 'missing' status FROM documents ANTI JOIN l USING (doc_id) UNION ALL SELECT doc_id, 'extra' FROM l ANTI JOIN documents USING (doc_id)",
    "question_drift": """SELECT doc_id, 'lang' AS "column", lang left_value, CAST(NULL AS VARCHAR) right_value FROM documents WHERE doc_id % 50 = 0 AND lang IS NOT NULL
        UNION ALL SELECT doc_id, 'source', source, 'moved' FROM documents WHERE doc_id % 70 = 0 AND source IS DISTINCT FROM 'moved'""",
    "fold_crossing": "SELECT o_custkey % 500 \"identity\", count(DISTINCT o_custkey % 7) folds FROM orders GROUP BY 1 HAVING folds > 1",
    "conversation_validation": """WITH c AS (SELECT conv_id, arg_min(role, (turn, role, text)) f, count_if(role = 'assistant') a, count_if(role = 'assistant' AND trim(coalesce(text, '')) = '') e,
        sum(CASE WHEN role = 'assistant' THEN (length(text) - length(replace(text, '<image>', ''))) / 7 ELSE 0 END) m, sum(CASE WHEN role = 'user' THEN (length(text) - length(replace(text, '<image>', ''))) / 7 ELSE 0 END) n,
        count_if(role NOT IN ('user', 'assistant')) o FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, CASE WHEN f <> 'user' THEN 'must start with a human turn' WHEN n > 1 THEN 'more than one image' WHEN o > 0 THEN 'unsupported role'
        WHEN m > 0 OR e > 0 THEN 'invalid answer' WHEN a = 0 THEN 'no answer' END fault FROM c) SELECT * FROM x WHERE fault IS NOT NULL""",
    "conversation_segments": """WITH t AS (SELECT conv_id, role, string_split(replace(text, '. ', '. <image> '), '<image>') p FROM conversations), x AS (SELECT conv_id, role, unnest(p) v, generate_subscripts(p, 1) i FROM t),
        y AS (SELECT conv_id, 'text' kind, role = 'assistant' loss, trim(v) v FROM x WHERE trim(v) <> '' UNION ALL SELECT conv_id, 'image', false, NULL FROM x WHERE i > 1)
        SELECT conv_id, kind, loss, count(*) parts, CAST(sum(coalesce(length(v), 0)) AS BIGINT) chars FROM y GROUP BY ALL""",
    "history_accumulation": """SELECT conv_id, turn, count(*) OVER w turns_before, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) chars_before FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "hash_topk": "SELECT doc_id FROM documents ORDER BY sha256('20260826' || chr(0) || doc_id), doc_id LIMIT 25",
    "hash_topk_per_group": "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('42' || chr(0) || o_orderkey), o_orderkey) <= 10",
    "fold_assignment": "SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY sha256('20260826' || chr(0) || doc_id), doc_id) - 1) % 5 AS INTEGER) fold FROM documents",
    "occurrence_counter": "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) repeat_index FROM events",
    "ordered_uid_hash": "SELECT n_regionkey, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) digest FROM nation GROUP BY 1",
    "strided_shards": "SELECT o_orderkey % 7 shard, count(*) \"rows\", CAST(sum(o_orderkey) AS BIGINT) \"keys\" FROM orders GROUP BY 1",
    "contiguous_shards": "WITH n AS (SELECT count(*) // 7 k FROM documents) SELECT doc_id // k shard, count(*) \"rows\", min(doc_id) \"first\", max(doc_id) \"last\" FROM documents, n WHERE doc_id < 7 * k GROUP BY 1",
    "circular_variants": """WITH p AS (SELECT p_partkey i, [p_brand, p_type, CAST(p_size AS VARCHAR), p_name] o, p_partkey % 4 a, r FROM part, range(4) x(r))
        SELECT i + r * 1000000 AS "index", i g_index, o[r % 4 + 1] "A", o[(1 + r) % 4 + 1] "B", o[(2 + r) % 4 + 1] "C", o[(3 + r) % 4 + 1] "D", ['A', 'B', 'C', 'D'][(a - r + 4) % 4 + 1] answer FROM p""",
    "tagged_union": "SELECT origin, segment, count(*) \"rows\", CAST(sum(k) AS BIGINT) \"keys\" FROM (SELECT 'customer' origin, c_mktsegment segment, c_custkey k FROM customer UNION ALL SELECT 'supplier', NULL, s_suppkey FROM supplier) GROUP BY ALL",
    "missing_grid": "WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events) SELECT a.user_id, b.day FROM (SELECT DISTINCT user_id FROM e) a, (SELECT DISTINCT day FROM e) b EXCEPT SELECT user_id, day FROM e",
    "running_curriculum": """WITH r AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) t, sum(t) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - t b FROM orders)
        SELECT CASE WHEN b < 1000 THEN 0 WHEN b < 3500 THEN 1 ELSE 2 END phase, count(*) "rows", CAST(sum(t) AS BIGINT) targets, min(o_orderkey) "first" FROM r GROUP BY 1""",
    "budget_round_up": "SELECT p_partkey, CAST(ceil(p_size / 8) * 8 AS BIGINT) samples FROM part",
    "interval_merge": f"WITH {_SPANS}, {_ISLANDS.format(by='user_id', t='spans')} SELECT user_id, min(s) \"start\", max(e) \"end\", count(*) merged FROM i GROUP BY user_id, g",
    "interval_iou": f"""WITH {_SPANS}, u AS (SELECT DISTINCT user_id FROM spans WHERE event_type IN ('click', 'view')), v AS (SELECT * FROM spans WHERE event_type IN ('click', 'view')), {_ISLANDS.format(by='user_id, event_type', t='v')},
        m AS (SELECT user_id, event_type, min(s) s, max(e) e FROM i GROUP BY user_id, event_type, g), l AS (SELECT user_id, sum(e - s) t FROM m GROUP BY 1),
        x AS (SELECT a.user_id, sum(greatest(least(a.e, b.e) - greatest(a.s, b.s), 0)) x FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1)
        SELECT user_id, round(coalesce(coalesce(x, 0) / nullif(t - coalesce(x, 0), 0), 0), 6) iou FROM u LEFT JOIN l USING (user_id) LEFT JOIN x USING (user_id)""",
    "nearest_spans": f"""WITH {_SPANS}, p AS (SELECT a.event_id, b.event_id other, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) x, a.e - a.s m, b.e - b.s n FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'),
        t AS (SELECT event_id, arg_min(other, (-x / (m + n - x), other)) "match", max(x / (m + n - x)) iou FROM p WHERE x > 0 GROUP BY 1)
        SELECT user_id, event_id, "match", round(coalesce(iou, 0), 6) iou FROM spans LEFT JOIN t USING (event_id) WHERE event_type = 'click'""",
    "box_iou": """WITH b AS (SELECT l_returnflag, l_quantity x1, l_linenumber y1, l_quantity + 10 x2, l_linenumber + 5 y2, l_linenumber * 5 u1, l_linenumber + 1 v1, l_linenumber * 5 + 12 u2, l_linenumber + 4 v2 FROM lineitem),
        c AS (SELECT *, greatest(least(x2, u2) - greatest(x1, u1), 0) * greatest(least(y2, v2) - greatest(y1, v1), 0) i FROM b), e AS (SELECT *, i / (50 + 36 - i) iou FROM c)
        SELECT l_returnflag, round(avg(iou), 6) iou, round(avg(CAST(iou >= 0.5 AS INTEGER)), 6) "precision", round(avg(CAST((x1 + x2) / 2 BETWEEN u1 AND u2 AND (y1 + y2) / 2 BETWEEN v1 AND v2 AS INTEGER)), 6) inside,
        round(avg(greatest(least(x2, u2) - greatest(x1, u1), 0) / (greatest(x2, u2) - least(x1, u1))), 6) span FROM e GROUP BY 1""",
    "status_latest_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "diagnostics_counts": "SELECT count(*) \"rows\", count_if(event_type = 'error') fallbacks, count_if(event_type <> 'error' AND event_id % 11 = 0) unresolved FROM events",
    "remaining_work": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "dependency_closure": """SELECT o_orderkey, row_number() OVER w - 1 ancestors, first_value(o_orderkey) OVER w root FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "json_normalize_group": "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 5 k, count(*) n, round(avg(value), 6) mean FROM events GROUP BY ALL",
    "event_tumbling_window": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS \"start\", event_type, count(*) n, round(sum(value), 6) total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) t, CAST(coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000, true) AS INTEGER) b FROM events),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) i FROM g) SELECT user_id, min(t) AS "start", count(*) n FROM s GROUP BY user_id, i""",
    #: The digest's first eight bytes in turned order, as text digits: 2^64 times what a double holds exactly.
    "stable_seeds": """WITH h AS (SELECT n_nationkey, n_name, sha256('7:' || n_name) h FROM nation), b AS (SELECT n_nationkey, n_name, i, CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS INTEGER) b FROM h, range(8) t(i))
        SELECT n_nationkey, sha256('7' || chr(0) || n_name) "rank", CAST(sum(b * CAST(pow(2::HUGEINT, 8 * i) AS HUGEINT)) % 9223372036854775807::HUGEINT AS BIGINT) seed FROM b GROUP BY n_nationkey, n_name""",
    "connected_components_folds": """WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey a, 'p' || CAST(floor(o_totalprice) AS BIGINT) b FROM orders), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        l(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM both_ GROUP BY a UNION SELECT x.a, min(n.root) FROM both_ x JOIN l n ON n.node = x.b JOIN recurring.l o ON o.node = x.a WHERE n.root < o.root GROUP BY x.a)
        SELECT root, count(*) members FROM l GROUP BY 1""",
}
