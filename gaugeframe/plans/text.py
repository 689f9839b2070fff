"""Text and answer scoring over the benchmark, conversations, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import numeric as N
from gaugeframe.functions import pytext as P
from gaugeframe.functions import text as T
from gaugeframe.operators import reports

from .facts import read, rounded


def _pairs(spark, d):
    """Benchmark items with the next but one, other characters than ASCII as question marks: DuckDB counts their bytes."""
    items = read(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"[^ -~\n]", "?"))
    other = items.select((F.col("item_id") - 2).alias("item_id"), F.col("text").alias("other"))
    return items.join(other, "item_id")


def text_normalise(spark, d):
    """P1, P2"""
    rows = read(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.format_string("%.1f", F.col("p_size").cast("double")), F.lit(" ")).alias("index"), F.concat(F.lit("\t"), F.col("p_name"), F.lit("\n  x")).alias("text"))
    return rows.select("p_partkey", T.normal_index(F.col("index")).alias("index"), T.collapse(F.col("text")).alias("text"))


def anls_score(spark, d):
    return rounded(_pairs(spark, d).select("item_id", F.levenshtein("text", "other").alias("distance"), T.anls_distance(F.col("text"), F.col("other")).alias("anls")))


def relaxed_numeric_match(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("truth"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("."))).when(F.col("p_partkey") % 3 == 1, F.concat(((F.col("p_size") * 104).cast("string")), F.lit("%"))).otherwise(F.col("p_brand")).alias("said"))
    return rows.select("p_partkey", T.relaxed_match(F.col("truth"), F.col("said")).alias("relaxed"), T.relaxed_match(F.col("truth"), F.col("said"), strip_dots=True).alias("dotless"))


def weighted_then_macro_edit(spark, d):
    rows = _pairs(spark, d).select((F.col("item_id") % 5).alias("page"), F.levenshtein("text", "other").alias("e"), F.greatest(F.length("text"), F.length("other")).alias("n"))
    return rounded(reports.weighted_then_macro(rows, "page", F.col("e"), F.col("n")))


def token_multiset_f1(spark, d):
    """Matched tokens are the sums of the smaller counts; macro and micro measures."""
    rows = _pairs(spark, d)
    count = lambda c, n: rows.select("item_id", F.explode(T.tokens(F.lower(F.col(c)))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias(n))
    per = count("text", "a").join(count("other", "b"), ["item_id", "w"], "full").groupBy("item_id").agg(F.sum(F.coalesce(F.least("a", "b"), F.lit(0)) * F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("m"), F.coalesce(F.sum("a"), F.lit(0)).alias("t"), F.coalesce(F.sum("b"), F.lit(0)).alias("p"))
    eps = 1e-9
    per = per.withColumn("r", F.col("m") / (F.col("t") + eps)).withColumn("q", F.col("m") / (F.col("p") + eps))
    f1 = lambda q, r: 2 * q * r / (q + r + eps)
    micro = lambda c: F.sum("m") / (F.sum(c) + eps)
    return rounded(per.agg(F.count("*").alias("pairs"), F.avg(f1(F.col("q"), F.col("r"))).alias("macro_f1"), f1(micro("p"), micro("t")).alias("micro_f1")))


def _asked(spark, d):
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("The answer is ("), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_size") % 4 + 1).cast("int")), F.lit(").")))
    said = said.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("It is "), F.col("p_brand"))).when(F.col("p_partkey") % 4 == 2, F.lit("A or B, I can't say")).otherwise(F.lit("B is a thing that one may well see here"))
    return read(spark, d, "part").select("p_partkey", said.alias("said"), F.col("p_brand").alias("A"), F.concat(F.lit("not "), F.col("p_type")).alias("B"), F.lit("zzz yyy").alias("C"), F.lit("none of them").alias("D"))


def option_inference(spark, d):
    """F1, F2, F3, F6"""
    options = {k: F.col(k) for k in "ABCD"}
    return _asked(spark, d).select("p_partkey", T.infer_option(F.col("said"), list("ABCD")).alias("letter"), T.infer(F.col("said"), options).alias("inferred"), T.option_letter(F.col("said")).alias("first_letter"))


def yes_no_extraction(spark, d):
    """F7, F8, F62"""
    said = F.element_at(F.array(F.lit("Yes, it is."), F.lit("no!"), F.lit("Yes and no"), F.lit("true story"), F.lit("I know nothing"), F.lit("not false, so true")), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = read(spark, d, "part").withColumn("said", said)
    return rows.groupBy("said").agg(F.count("*").alias("n"), F.first(T.yes_no(F.col("said"))).alias("yes_no"), F.first(T.first_yes_no(F.col("said"))).alias("first"), F.first(T.true_false(F.col("said"))).alias("truth"))


def set_scores(spark, d):
    """F40, F41, F42 over the words of neighbouring parts' names."""
    rows = read(spark, d, "part").select(F.col("p_partkey"), F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    both = rows.withColumn("c", F.concat("a", "b"))
    return rounded(both.select("p_partkey", N.jaccard(F.col("a"), F.col("c")).alias("jaccard"), N.set_equal(F.col("a"), F.col("c")).alias("equal"), N.set_precision(F.col("c"), F.col("a")).alias("precision"), N.common_prefix_ratio(F.col("a"), F.col("c")).alias("prefix")))


def relative_accuracy(spark, d):
    """F38, F45"""
    rows = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg(N.mean_relative_accuracy(F.col("l_quantity"), F.col("l_linenumber") * 7.0)).alias("mra"), F.avg(N.relative_closeness(F.col("l_quantity"), F.col("l_linenumber") * 7.0)).alias("closeness"))
    return rounded(rows)


def answer_normalisation(spark, d):
    """F9, F10, F11 over the texts of all roles."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return rows.select("conv_id", "turn", P.column(P.plain_answer, "string", F.col("text")).alias("plain"))


def _whole_pairs(spark, d):
    """Benchmark items with the next but one, as they are."""
    items = read(spark, d, "benchmark")
    return items.join(items.select((F.col("item_id") - 2).alias("item_id"), F.col("text").alias("other")), "item_id")


def near_string_match(spark, d):
    """F46 over whole texts, code point by code point."""
    return _whole_pairs(spark, d).select("item_id", P.column(P.damerau, "int", F.col("text"), F.col("other")).alias("distance"))


def bleu_scores(spark, d):
    """F50 over whole texts."""
    return _whole_pairs(spark, d).select("item_id", F.round(P.column(lambda a, b: P.bleu(a.split(), b.split()), "double", F.col("text"), F.col("other")), 6).alias("bleu"))


def failed_predictions(spark, d):
    """How many answers hold the failure message."""
    said = F.when(F.col("event_type") == "error", F.lit(T.FAILURE + " (timeout)")).otherwise(F.col("props"))
    return rounded(read(spark, d, "events").agg(F.count("*").alias("rows"), F.count_if(F.contains(said, F.lit(T.FAILURE))).alias("failed"), F.avg(F.contains(said, F.lit(T.FAILURE)).cast("int")).alias("rate")))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_PAIRS = r"items AS (SELECT item_id, regexp_replace(text, '[^ -~\n]', '?', 'g') AS text FROM benchmark), pairs AS (SELECT a.item_id, a.text, b.text other FROM items a JOIN items b ON b.item_id = a.item_id + 2)"
_TRIM = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_SAID = """said AS (SELECT p_partkey, p_brand, p_type, CASE p_partkey % 4 WHEN 0 THEN 'The answer is (' || ['A', 'B', 'C', 'D'][p_size % 4 + 1] || ').' WHEN 1 THEN 'It is ' || p_brand WHEN 2 THEN 'A or B, I can''t say' ELSE 'B is a thing that one may well see here' END s, p_size FROM part)"""
_SPELLED = "MAP {" + ", ".join(f"'{a.replace(chr(39), chr(39) * 2)}': '{b.replace(chr(39), chr(39) * 2)}'" for a, b in {**P.DIGITS, **P.CONTRACTIONS}.items()) + "}"
_MARKS = ", ".join("'" + p + "'" for p in P.PUNCTUATION)
SQL = {
    #: Marks go or become spaces, lone dots go (the first 32), then words are looked up.
    "answer_normalisation": f"""WITH c AS (SELECT conv_id, turn, trim(replace(replace(text, chr(10), ' '), chr(9), ' ')) t FROM conversations), m AS (SELECT conv_id, turn, t, regexp_matches(t, '[0-9],[0-9]') g, string_split(t, '') s FROM c),
        p AS (SELECT conv_id, turn, array_to_string(list_transform(s, lambda x: CASE WHEN x NOT IN ({_MARKS}) THEN x WHEN g OR contains(t, x || ' ') OR contains(t, ' ' || x) THEN '' ELSE ' ' END), '') t FROM m),
        d AS (SELECT conv_id, turn, string_split(t, '') s FROM p), e AS (SELECT conv_id, turn, s, list_filter(range(1, len(s) + 1), lambda i: s[i] = '.' AND NOT coalesce(regexp_matches(s[i - 1], '[0-9]') AND i > 1, false) AND NOT coalesce(regexp_matches(s[i + 1], '[0-9]'), false))[1:32] h FROM d),
        f AS (SELECT conv_id, turn, regexp_extract_all(lower(array_to_string(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN list_contains(h, i) THEN '' ELSE s[i] END), '')), '\\S+') w FROM e)
        SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ('a', 'an', 'the')), lambda x: coalesce({_SPELLED}[x], x)), ' ') "plain" FROM f""",
    "bleu_scores": r"""WITH p AS (SELECT a.item_id, regexp_extract_all(a.text, '\S+') t, regexp_extract_all(b.text, '\S+') f FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 2), s AS (SELECT item_id, 1 side, t w FROM p UNION ALL SELECT item_id, 2, f FROM p),
        g AS (SELECT item_id, side, n, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT item_id, side, n, w, unnest(range(1, len(w) - n + 2)) i FROM s, (VALUES (1), (2), (3), (4)) t(n))), c AS (SELECT item_id, n, g, count_if(side = 1) a, count_if(side = 2) b FROM g GROUP BY ALL),
        o AS (SELECT item_id, n, sum(least(a, b)) m, sum(b) t FROM c GROUP BY ALL), k AS (SELECT *, sum(CAST(m = 0 AS INTEGER)) OVER (PARTITION BY item_id ORDER BY n) z FROM o),
        l AS (SELECT item_id, sum(ln(CASE WHEN m > 0 THEN m / t ELSE 1 / (pow(2, z) * t) END)) / 4 l, count_if(t > 0) k FROM k GROUP BY 1)
        SELECT item_id, round(CASE WHEN k < 4 THEN 0 ELSE exp(l) * CASE WHEN len(f) >= len(t) THEN 1 ELSE exp(1 - len(t) / CAST(len(f) AS DOUBLE)) END END, 6) bleu FROM l JOIN p USING (item_id)""",
    "text_normalise": r"SELECT p_partkey, CAST(p_size AS VARCHAR) AS \"index\", trim(regexp_replace(p_name || ' x', '\s+', ' ', 'g')) AS \"text\" FROM part".replace('\\"', '"'),
    "anls_score": f"WITH {_PAIRS} SELECT item_id, CAST(levenshtein(text, other) AS INTEGER) distance, round(levenshtein({_TRIM.format(c='text')}, {_TRIM.format(c='other')}) / greatest(length(text), length(other)), 6) anls FROM pairs",
    "relaxed_numeric_match": """WITH r AS (SELECT p_partkey, p_size t, CASE p_partkey % 3 WHEN 0 THEN 'dot' WHEN 1 THEN 'percent' ELSE p_brand END s FROM part)
        SELECT p_partkey, s <> 'x' AND (s = 'dot' OR (s = 'percent' AND t <> 0)) AS relaxed, s = 'dot' OR (s = 'percent' AND t <> 0) AS dotless FROM r""",
    "weighted_then_macro_edit": f"WITH {_PAIRS}, g AS (SELECT item_id % 5 page, sum(levenshtein(text, other)) / sum(greatest(length(text), length(other))) r FROM pairs GROUP BY 1) SELECT count(r) pages, round(avg(r), 6) score FROM g",
    "token_multiset_f1": rf"""WITH {_PAIRS}, t AS (SELECT item_id, 1 k, unnest(regexp_extract_all(lower(text), '\S+')) w FROM pairs UNION ALL SELECT item_id, 2, unnest(regexp_extract_all(lower(other), '\S+')) FROM pairs),
        c AS (SELECT item_id, w, count_if(k = 1) a, count_if(k = 2) b FROM t GROUP BY ALL), p AS (SELECT item_id, sum(least(a, b)) m, sum(a) t, sum(b) p FROM c GROUP BY 1),
        q AS (SELECT *, m / (p + 1e-9) q, m / (t + 1e-9) r FROM p), x AS (SELECT count(*) pairs, avg(2 * q * r / (q + r + 1e-9)) macro, sum(m) / (sum(p) + 1e-9) mq, sum(m) / (sum(t) + 1e-9) mr FROM q)
        SELECT pairs, round(macro, 6) macro_f1, round(2 * mq * mr / (mq + mr + 1e-9), 6) micro_f1 FROM x""",
    "option_inference": f"""WITH {_SAID} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['A', 'B', 'C', 'D'][p_size % 4 + 1] END letter,
        CASE p_partkey % 4 WHEN 0 THEN ['A', 'B', 'C', 'D'][p_size % 4 + 1] WHEN 1 THEN CASE WHEN contains(lower(s), 'not ' || lower(p_type)) THEN NULL ELSE 'A' END END inferred,
        CASE p_partkey % 4 WHEN 0 THEN ['A', 'B', 'C', 'D'][p_size % 4 + 1] ELSE regexp_extract(s, '[ABCDE]') END first_letter FROM said""",
    "yes_no_extraction": """WITH s AS (SELECT ['Yes, it is.', 'no!', 'Yes and no', 'true story', 'I know nothing', 'not false, so true'][p_partkey % 6 + 1] said FROM part)
        SELECT said, count(*) n, CASE said WHEN 'Yes, it is.' THEN 'Yes' WHEN 'no!' THEN 'No' ELSE 'Unknown' END yes_no, CASE WHEN said LIKE 'Yes%' THEN 1 WHEN said = 'no!' THEN 0 ELSE -1 END "first", CASE said WHEN 'true story' THEN 1 END truth FROM s GROUP BY ALL""",
    "set_scores": """WITH r AS (SELECT p_partkey, string_split(p_name, ' ') a, string_split(p_type, ' ') b FROM part), s AS (SELECT p_partkey, a, list_distinct(a) da, list_concat(a, b) c FROM r)
        SELECT p_partkey, round(len(list_intersect(da, list_distinct(c))) / len(list_distinct(c)), 6) jaccard, len(list_distinct(c)) = len(da) equal, round(len(da) / len(list_distinct(c)), 6) "precision", round(len(a) / len(c), 6) prefix FROM s""",
    "relative_accuracy": """WITH e AS (SELECT l_linenumber, abs(l_linenumber * 7.0 - l_quantity) / abs(nullif(l_quantity, 0)) e FROM lineitem)
        SELECT l_linenumber, round(avg((SELECT count(*) FROM range(10) t(i) WHERE e <= 1 - (0.5::DOUBLE + 0.05::DOUBLE * i)) / 10), 6) mra, round(avg(greatest(0, 1 - e)), 6) closeness FROM e GROUP BY 1""",
    "failed_predictions": "SELECT count(*) \"rows\", count_if(event_type = 'error') failed, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) rate FROM events",
}
