"""Components with locked folds, keyed state in streams, filtered semi joins, archives, reports as files and judges over
the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import bloom, expanders, folds, judging, quantiles, reshape, tables, validation, variants
from gaugeframe.sources import archives, members, writers
from gaugeframe.streaming import states

from .facts import read, rounded


def component_folds(spark, d):
    """G1: customers that share an order's price in whole units; the first customer is locked by a reference pool."""
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.floor("o_totalprice").alias("price"))
    pool = rows.agg(F.min("o_custkey").alias("c")).select(F.concat(F.lit("source:"), F.col("c")).alias("identity"), F.lit(4).alias("fold"))
    found = folds.component_folds(rows, "o_orderpriority", "o_custkey", F.array("price"), 5, 20260826, pool=pool)
    return found.groupBy("component", "fold").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


def document_folds(spark, d):
    """G1: documents that share a whole text or all their words in order; copies of the first document's text are locked."""
    rows = read(spark, d, "documents").select("doc_id", "lang", F.array(F.md5("text"), F.md5(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " "))).alias("same"))
    locked = rows.withColumn("held", F.when(F.col("doc_id") == 0, 2))
    return folds.component_folds(locked, "lang", "doc_id", F.col("same"), 5, 7, locked="held").select("doc_id", "component", "fold")


def streamed_status(spark, d):
    """The last event of each user, from a stream of files that is brought up to date twice: half of the events
    each time, so that the second run finds the state of the first."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", "value")
    folder, changed, checkpoint = (tables.place(spark) for _ in range(3))
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        states.streamed(spark, folder, rows.schema, ["user_id"], ["at", "event_id"], "event_type", changed, checkpoint)
    return states.current(spark, changed, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "event_type", "value")


def bloom_remaining(spark, d):
    """Orders without a line that was returned, by a filtered anti join."""
    returned = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return bloom.filtered_anti(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), returned, ["o_orderkey"])


def bloom_digest_semi(spark, d):
    """Documents whose text is that of a labelled one, by digest; the filter is small, so many rows are confirmed."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    wanted = docs.join(read(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("digest")
    return bloom.filtered_semi(docs, wanted, ["digest"], bits=1 << 16)


def exact_quantiles(spark, d):
    """The quartile and the median of prices by flag and line, as of groups too large for one buffer."""
    rows = read(spark, d, "lineitem")
    low = quantiles.exact_quantile(rows, "l_extendedprice", 0.25, ["l_returnflag", "l_linestatus"], "quartile", small=100)
    mid = quantiles.exact_quantile(rows, "l_discount", 0.5, ["l_returnflag", "l_linestatus"], "median", small=100)
    return rounded(low.join(mid, ["l_returnflag", "l_linestatus"]))


def archive_members(spark, d):
    """The texts of labelled documents out of archives of a hundred documents each, by name."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select(F.concat(F.lit("part-"), F.floor(F.col("doc_id") / 100), F.lit(".tar")).alias("archive"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("name"), "text")
    wanted = read(spark, d, "labels").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("name"))
    found = archives.members_of(archives.packed(docs, "archive", "name", "text"), wanted)
    return found.select("archive", "name", F.sha2("content", 256).alias("digest"), "gap")


def indexed_archives(spark, d):
    """Texts of labelled documents out of archive files, which are written from all documents, indexed by their headers
    and read only where a wanted member lies."""
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    named = F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt"))
    folder = tables.place(spark)
    members.write_archives(docs, F.concat(F.lit("part-"), F.floor(F.col("doc_id") / 250), F.lit(".tar")), named, F.col("text"), folder)
    found = members.wanted_contents(spark, folder, read(spark, d, "labels").select(named.alias("name")))
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "name", "size", "piece", F.sha2("content", 256).alias("digest"), "gap")


def numbered_segments(spark, d):
    """The segments of whole conversations, numbered and measured from turn to turn by a table function."""
    marked = read(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"\. ", ". <image> "))
    return expanders.numbered_segments(marked).select("conv_id", "turn", "position", "kind", F.md5("value").alias("digest"), "loss", "ordinal", "chars_before")


def shared_keys(spark, d):
    """U4: orders that are both urgent and returned in part, which a split into retained and excluded must not have."""
    orders = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("uid"))
    return validation.shared(orders, read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("uid")), ["uid"])


def merged_ranks(spark, d):
    """Of results that four workers wrote, the one of the last worker for each user; within it the newest."""
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 4).alias("rank"), "ts", "value")
    return reshape.latest(rows, ["user_id"], F.struct("rank", "ts", "event_id")).select("user_id", "rank", "event_id", "value")


def report_files(spark, d):
    """K2, K3, K9: the sections of a report as CSV files beside each other, read back."""
    rows = read(spark, d, "orders")
    means = lambda by: rows.groupBy(F.col(by).cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("total"))
    sections = {"status": means("o_orderstatus"), "priority": means("o_orderpriority")}
    path = writers.derived_path(f"{tables.place(spark)}/orders.parquet", "_report", "csv")
    writers.report(sections, path)
    parts = [spark.read.schema("name string, n long, total long").option("header", True).csv(f"{path}/{s}").select(F.lit(s).alias("section"), "name", "n", "total") for s in sections]
    return parts[0].unionByName(parts[1])


def _questions(spark, d):
    """Multiple-choice answers: a letter, an option's text, both or neither."""
    letter = lambda n: F.substring(F.lit("AB"), (n % 2 + 1).cast("int"), F.lit(1))
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    said = F.when(size % 4 == 0, F.concat(F.lit("It is "), letter(size / 4))).when(size % 4 == 1, F.concat(F.lit("the text says "), F.col("p_brand"))).when(size % 4 == 2, F.lit("I can't tell")).otherwise(letter(key / 3))
    return read(spark, d, "part").select("p_partkey", said.alias("prediction"), letter(key).alias("answer"), F.col("p_brand").alias("A"), F.lit("none of the brands").alias("B"), F.when(size > 25, "large").otherwise("small").alias("split"), (key % 7).cast("string").alias("category"))


def evaluated_choices(spark, d):
    """The benchmark class is told from the columns and rolls its hits up."""
    return rounded(judging.evaluate(_questions(spark, d)))


def judged_choices(spark, d):
    """A judge is asked where the rules find nothing; it fails for one prompt in three."""

    def judge(prompt: str) -> str:
        n = int(prompt.rpartition(" ")[2])
        if n % 3 == 0:
            raise TimeoutError
        return "The answer is B." if n % 3 == 1 else "hard to say"

    rows = _questions(spark, d).withColumn("prompt", F.concat(F.lit("Which option is meant? "), F.col("p_partkey")))
    return judging.judged_options(rows, "prediction", ["A", "B"], "prompt", judge, "legacy").select("p_partkey", "option", "log")


def _documents_of_events(spark, d):
    return read(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(F.parse_json("props").alias("props"), F.array(F.col("user_id"), F.col("event_id")).alias("ids")).alias("a"), F.col("event_type").alias("e"))).alias("doc"))


def json_paths(spark, d):
    """Leaves of nested documents by path, from the properties of events."""
    return variants.json_paths(_documents_of_events(spark, d), "doc", ["event_id"])


def merged_paths(spark, d):
    """Settings of each event over a common base, by path: e is replaced, a.ids[1] goes on, a.more is added."""
    base = variants.json_paths(_documents_of_events(spark, d), "doc", ["event_id"])
    over = read(spark, d, "events").where("event_id % 3 = 0").select("event_id", F.to_json(F.struct(F.struct(F.col("event_id").alias("props"), F.lit("x").alias("more")).alias("a"), F.struct(F.lit(1).alias("deep")).alias("e"))).alias("doc"))
    return variants.merged_paths(base, variants.json_paths(over, "doc", ["event_id"]), ["event_id"])


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}


def _folds_sql(edges: str, rows: str, lock: str, seed: int, select: str) -> str:
    """``rows`` (id, source, task) and ``edges`` (a, b) by least labels; ``lock`` gives (component, fold) of the locked."""
    return f"""WITH RECURSIVE r AS ({rows}), e AS (SELECT DISTINCT a, b FROM ({edges}) WHERE b IS NOT NULL), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        l(node, root) USING KEY (node) AS (SELECT a, least(a, min(b)) FROM both_ GROUP BY a UNION SELECT x.a, min(n.root) FROM both_ x JOIN l n ON n.node = x.b JOIN recurring.l o ON o.node = x.a WHERE n.root < o.root GROUP BY x.a),
        c AS (SELECT r.*, coalesce(root, source) component FROM r LEFT JOIN l ON l.node = r.source),
        t AS (SELECT component, min(task) task FROM c GROUP BY 1), k AS ({lock}),
        f AS (SELECT component, coalesce(k.fold, (row_number() OVER (PARTITION BY task ORDER BY sha256('{seed}' || chr(0) || component), component) - 1) % 5) fold FROM t LEFT JOIN k USING (component))
        {select}"""


_ASKED = """q AS (SELECT p_partkey, substr('AB', CAST(p_partkey % 2 + 1 AS INTEGER), 1) answer, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END split, CAST(p_partkey % 7 AS VARCHAR) category,
  CASE p_size % 4 WHEN 0 THEN substr('AB', CAST(p_size // 4 % 2 + 1 AS INTEGER), 1) WHEN 1 THEN 'A' WHEN 2 THEN NULL ELSE substr('AB', CAST(p_partkey // 3 % 2 + 1 AS INTEGER), 1) END said FROM part)"""
_PATHS = """leaves AS (SELECT event_id, unnest(['.a.props.k', '.a.ids[0]', '.a.ids[1]', '.e']) path, unnest([json_extract_string(props, '$.k'), user_id || '', event_id || '', event_type]) "value" FROM events)"""
SQL = {
    "json_paths": f"WITH {_PATHS} FROM leaves",
    "merged_paths": f"""WITH {_PATHS} SELECT * FROM leaves WHERE event_id % 3 <> 0 OR path LIKE '.a.ids%' UNION ALL
        SELECT event_id, unnest(['.a.props', '.a.more', '.e.deep']), unnest([event_id || '', 'x', '1']) FROM events WHERE event_id % 3 = 0""",
    "shared_keys": "SELECT o_orderkey uid FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
    "merged_ranks": "SELECT user_id, event_id % 4 \"rank\", event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, ts DESC, event_id DESC) = 1",
    "report_files": """SELECT section, name, count(*) n, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) total FROM (SELECT 'status' section, o_orderstatus AS name, o_totalprice FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_totalprice FROM orders) GROUP BY 1, 2""",
    "evaluated_choices": f"""WITH {_ASKED}, h AS (SELECT split, category, CAST(coalesce(said = answer, false) AS INTEGER) hit FROM q)
        SELECT split, 'Overall' AS level, 'Overall' AS name, count(*) n, round(avg(hit), 6) accuracy FROM h GROUP BY 1 UNION ALL SELECT split, 'category', category, count(*), round(avg(hit), 6) FROM h GROUP BY 1, 3""",
    "judged_choices": f"""WITH {_ASKED} SELECT p_partkey, coalesce(said, CASE WHEN p_partkey % 3 = 1 THEN 'B' ELSE 'Z' END) "option",
        CASE WHEN said IS NOT NULL THEN '' WHEN p_partkey % 3 = 0 THEN 'Exact matching fallback: Z' WHEN p_partkey % 3 = 1 THEN '' ELSE 'Unresolved LLM judge response.' END log FROM q""",
    "archive_members": "SELECT DISTINCT 'part-' || doc_id // 100 || '.tar' archive, 'docs/' || doc_id || '.txt' AS name, sha256(text) digest, NULL gap FROM documents JOIN labels USING (doc_id)",
    "indexed_archives": "SELECT DISTINCT 'part-' || doc_id // 250 || '.tar' archive, 'docs/' || doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) size, CAST(0 AS BIGINT) piece, sha256(text) digest, NULL gap FROM documents JOIN labels USING (doc_id)",
    "numbered_segments": """WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) turn, role, text, string_split(replace(text, '. ', '. <image> '), '<image>') p FROM conversations), x AS (SELECT *, unnest(p) v, generate_subscripts(p, 1) i FROM t),
        y AS (SELECT conv_id, turn, role, text, 2 * i - 2 position, 'text' kind, v, role = 'assistant' loss FROM x WHERE trim(v, ' ') <> '' UNION ALL SELECT conv_id, turn, role, text, 2 * i - 3, 'image', NULL, false FROM x WHERE i > 1)
        SELECT conv_id, turn, CAST(position AS INTEGER) position, kind, md5(v) digest, loss, CAST(row_number() OVER w - 1 AS BIGINT) ordinal, CAST(coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) chars_before
        FROM y WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text, position)""",
    "bloom_remaining": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "bloom_digest_semi": "SELECT doc_id, lang, sha256(text) digest FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1)",
    "exact_quantiles": "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) quartile, round(quantile_cont(l_discount, 0.5), 6) \"median\" FROM lineitem GROUP BY 1, 2",
    "streamed_status": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "component_folds": _folds_sql(
        "SELECT 'source:' || o_custkey a, 'image:' || CAST(floor(o_totalprice) AS BIGINT) b FROM orders",
        "SELECT o_orderkey id, 'source:' || o_custkey source, o_orderpriority task FROM orders",
        "SELECT component, 4 fold FROM c WHERE source = (SELECT 'source:' || min(o_custkey) FROM orders) GROUP BY 1",
        20260826,
        "SELECT component, fold, count(*) orders, count(DISTINCT source) customers FROM c JOIN f USING (component) GROUP BY 1, 2",
    ),
    "document_folds": _folds_sql(
        "SELECT 'source:' || doc_id a, 'image:' || unnest([md5(text), md5(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))]) b FROM documents",
        "SELECT doc_id id, 'source:' || doc_id source, lang task FROM documents",
        "SELECT component, 2 fold FROM c WHERE source = 'source:0' GROUP BY 1",
        7,
        "SELECT id doc_id, component, fold FROM c JOIN f USING (component)",
    ),
}
