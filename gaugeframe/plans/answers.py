"""Answer parsing and matching rules over parts, orders and benchmark texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions import answers as A
from gaugeframe.functions import documents as O
from gaugeframe.functions import finals
from gaugeframe.functions import pytext as P
from gaugeframe.functions import text as T
from gaugeframe.operators import reports

from .facts import read, rounded


def _case(key: str, values: list[str]):
    """One of the texts for each key, by remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_case(key: str, values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


_CHOICES = ["(B) or maybe (A)", "A. it is", "it is C ", "B or D ", "surely one would say that it is the ", "none", "!C.", "D: (C) and A. "]


def multi_choice_parse(spark, d):
    """F18"""
    said = F.when(F.col("p_partkey") % 8 == 4, F.concat(_case("p_partkey", _CHOICES), F.col("p_type"), F.lit(" not the "), F.col("p_brand"))).otherwise(_case("p_partkey", _CHOICES))
    rows = read(spark, d, "part").withColumn("said", said)
    options = {"A": F.col("p_brand"), "B": F.upper("p_type"), "C": F.lit("zzz"), "D": F.lit(None).cast("string"), "E": F.col("p_name")}
    return rows.select("p_partkey", A.chosen_letter(F.col("said"), options).alias("letter"))


_REPLIES = ["x [Begin Correctness] Yes [End Correctness][Begin Reason] it fits [End Reason]", "[Begin Correctness] yes and no [End Correctness]", "[Begin Correctness]No.[End Correctness] so", "yes", "[End Correctness][Begin Correctness]yes"]


def judge_replies(spark, d):
    """F31"""
    rows = read(spark, d, "part").select("p_partkey", A.judge_verdict(F.concat(_case("p_partkey", _REPLIES), F.col("p_brand"))).alias("v"))
    return rows.select("p_partkey", "v.correct", "v.reason")


def critic_matches(spark, d):
    """F39"""
    said = F.concat(_case("p_partkey", ["", "x", ""]), F.lower("p_brand"), _case("p_partkey", [".", "", " ."]))
    return read(spark, d, "part").select("p_partkey", A.names_option(said, F.col("p_brand")).alias("right"))


_SAID, _TRUE = ["B", "(b) so", "New-York", "new york.", "-3", "7", "0", "a,b"], ["B", "b", "new york", "York", "-5", "7", "4", "A"]


def string_matches(spark, d):
    """F47"""
    rows = read(spark, d, "part").select("p_partkey", _case("p_partkey", _SAID).alias("said"), F.element_at(F.array(*map(F.lit, _TRUE)), (F.floor(F.col("p_partkey") / 8) % 8 + 1).cast("int")).alias("truth"), "p_size")
    said, truth = F.col("said"), F.col("truth")
    return rows.select(
        "p_partkey", A.exact_match(said, truth).alias("exact"), A.simple_match(said, truth).alias("simple"), A.any_match(said, F.array(truth, F.lit("7"))).alias("any"),
        A.positive_int_match(said, (F.col("p_size") % 9 - 1).cast("string")).alias("number"),
    )


_LETTERS = ["A", "B. long", "C) short", "D long", "Ax", "A. x"]


def letter_rules(spark, d):
    """F61"""
    answer = F.element_at(F.array(*map(F.lit, ["A. x", "B. y", "C"])), (F.floor(F.col("p_partkey") / 6) % 3 + 1).cast("int"))
    said = _case("p_partkey", _LETTERS)
    spoken = F.concat(_case("p_partkey", ["Yes, ", "no", "so ", "Not "]), F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", A.letter_rule(said, answer).alias("score"), A.leading_yes_no(spoken).alias("yes_no"))


def counting_prompts(spark, d):
    """F27"""
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("<think>Count the number of "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" in the image</think>")))
    return read(spark, d, "part").select("p_partkey", A.counted_category(asked).alias("category"), A.without_markup(asked).alias("plain"))


def clue_frame_sampling(spark, d):
    """F58"""
    span = lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"))
    size = F.col("p_size")
    rows = read(spark, d, "part").withColumn("f", A.clue_frames(F.array(span(size, size + 2.5), span(size * 2, size * 2 + size / 4 + 1)), F.col("p_partkey") % 9 + 1, 2.0))
    return rows.select("p_partkey", F.array_join("f", ",").alias("frames"))


def answer_match_methods(spark, d):
    """Four methods and three reductions over the words of a part's name."""
    rows = read(spark, d, "part").select("p_partkey", F.array(F.col("p_brand"), F.col("p_size").cast("string"), F.split("p_name", " ")[0]).alias("a"), F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.upper(F.split("p_name", " ")[0])), F.lit(" ")).alias("p"))
    m = lambda method: A.match_scores(F.col("a"), F.col("p"), method)
    return rounded(rows.select(
        "p_partkey", A.reduced_hit(m("anls"), "DocVQA").alias("anls"), A.reduced_hit(m("relaxed_accuracy"), "ChartQA").alias("relaxed"), A.reduced_hit(m("relaxed_accuracy_chartqa"), "TextVQA").alias("chart"),
        A.reduced_hit(m("accuracy"), "OCRVQA").alias("accuracy"), A.reduced_hit(m("normalised"), "TextVQA").alias("normalised"), A.reduced_hit(m("vqa_score"), "TextVQA").alias("vqa"),
    ))


#: Templates of answers; $1 to $4 are letters dealt by the row, so every order of A to D, and some that aren't one, occur.
_ORDERS = ["so $1$2$3$4 it is", "first $1, second $2, third $3, fourth $4", "Step 1 is $1. Step 2: $2; step 3 $3\nstep 4 $4", "I would say $1", "1st comes $2 and 2nd $1; 3rd $3", "step 1 $1 step 2 $2 step 3 $3 step 4 $4 step 5 $1"]


def _dealt(at: Column, template: Column) -> Column:
    """``template`` with $1 to $4 replaced by letters of A to D, by digits of the row's number to the base 4."""
    for i in range(4):
        template = F.replace(template, F.lit(f"${i + 1}"), F.substring(F.lit("ABCD"), (F.floor(at / 4**i) % 4 + 1).cast("int"), F.lit(1)))
    return template


def order_answers(spark, d):
    """the order of a sorting question, the letter of another."""
    key = F.col("p_partkey")
    kind = F.when(key % 2 == 0, "sort").otherwise("pick")
    said = _dealt(F.floor(key / len(_ORDERS)), _case("p_partkey", _ORDERS))
    options = {"A": F.col("p_brand"), "B": F.col("p_type"), "C": F.lit("zzz yyy"), "D": F.lit("none of them")}
    rows = read(spark, d, "part").select("p_partkey", finals.option_order(said).alias("order"), F.when(key % 2 == 0, A.infer_kind(said, kind, options)).alias("sorted"))
    return rows


_SOLVED = [
    "He makes $# today.", "It costs $# in all", "a total of # apples", "Work.\n#### #", "FINAL ANSWER: $#", "so \\boxed\\{#\\}, then 7 more", "the answer is #/8 of it", "$#/4", "so 2 + 2 = 5\n\nmakes $#",
    "no numbers", "#\ntwelve\n", "x = #\n\nand # dollars", "Thus it is #.\nThe result is: #", "$ #", "# cents", "5/0", "答案: #", "hence -#, and more", "#\n\nno more\nlines\nof any\nkind\nhere",
]


def _amount() -> Column:
    """An amount of the row as it is written: with commas, decimals, or as it is."""
    price = F.floor(F.col("p_retailprice") * F.col("p_size") * 10).cast("long")
    return F.when(F.col("p_size") % 3 == 0, F.format_number(price, 0)).when(F.col("p_size") % 3 == 1, F.concat(price.cast("string"), F.lit(".5"))).otherwise(price.cast("string"))


def numerical_answers(spark, d):
    """F20 over answers that hold amounts of the parts, with and without commas."""
    said = F.replace(_case("p_partkey", _SOLVED), F.lit("#"), F.lit("@"))
    said = F.replace(F.replace(said, F.lit("@@@@"), F.lit("####")), F.lit("@"), _amount())
    return rounded(read(spark, d, "part").select("p_partkey", finals.numerical_answer(said).alias("number")))


_LISTS = ["['a', 'b c']", "[x, y z]", "plain", "[1, 2.5]", "['open]"]


def list_answers(spark, d):
    """F24, F65"""
    key = F.col("p_partkey") % 5
    said = F.concat(_case("p_partkey", _LISTS), F.when(key == 2, F.col("p_brand")).otherwise(""))
    strict = P.column(P.text_list, "array<string>", F.when(~key.isin(1, 4), said))
    return read(spark, d, "part").select("p_partkey", F.array_join(strict, "|").alias("strict"), F.array_join(P.column(P.lenient_list, "array<string>", said), "|").alias("lenient"))


_TALK = ['a {"x": "}"} b {"y": {"z": 1}}', '```json\n{"k": 2}\n```', "no braces", '{"open": 1', '<think>{"t": 1}</think> {"u": 2}']


def json_answers(spark, d):
    """F21, F22, F23"""
    said = _case("p_partkey", _TALK)
    return read(spark, d, "part").select("p_partkey", F.array_join(P.column(P.json_objects, "array<string>", said), "|").alias("objects"), T.fenced_json(said).alias("fenced"), T.after_thinking(said).alias("after"))


def answer_helpers(spark, d):
    """F17, F25, F26, F28, F32"""
    rows = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", _case("p_partkey", ["图", "x", "a一b"]).alias("word"))
    c = F.col
    clock = F.when(c("p_partkey") % 3 == 0, F.concat_ws(":", c("p_size"), F.lit("05.5"))).when(c("p_partkey") % 3 == 1, F.concat_ws(":", F.lit("1"), c("p_size"), F.lit("30"))).otherwise(c("p_brand"))
    return rounded(rows.select(
        "p_partkey", T.either_contains(c("p_type"), F.concat(F.upper("p_type"), F.lit("."))).alias("either"), T.has_cjk(c("word")).alias("cjk"),
        T.option_prompt({"A": c("p_brand"), "B": F.when(c("p_size") > 25, c("p_type"))}).alias("prompt"),
        T.contained_answer(F.concat(F.lit(" Is "), F.upper("p_name"), F.lit("\n ?")), F.array(F.lit("zz"), c("p_name"))).alias("contained"),
        T.contained_answer(c("p_name"), F.array(F.replace("p_name", F.lit(" "), F.lit(""))), keep_case=True, keep_space=False).alias("spaceless"), T.clock_seconds(clock).alias("seconds"),
    ))


def canonical_digests(spark, d):
    """H4: equal content in another order of keys has the same digest."""
    text = F.concat(F.lit('{"z": '), F.col("p_size").cast("string"), F.lit(', "a": {"y": [1, 2], "b": "'), F.col("p_brand"), F.lit('"}}'))
    return read(spark, d, "part").select("p_partkey", F.sha2(P.column(P.canonical_json, "string", text), 256).alias("digest"))


def merged_settings(spark, d):
    """Defaults with a job's own settings laid over them."""
    base = F.lit('{"batch": 64, "model": {"lr": 2, "name": "m"}, "seed": 42}')
    over = F.concat(F.lit('{"model": {"lr": '), F.col("p_size").cast("string"), F.lit('}, "task": "'), F.col("p_brand"), F.lit('"}'))
    return read(spark, d, "part").select("p_partkey", P.column(P.merged_json, "string", base, over).alias("settings"))


#: Measures by name, each of a response and a truth.
METRICS = {
    "exact": lambda r, t: A.exact_match(r, t).cast("double"),
    "simple": lambda r, t: A.simple_match(r, t).cast("double"),
    "prefix": lambda r, t: A.names_option(r, t).cast("double"),
    "anls": lambda r, t: 1 - T.anls_distance(t, r),
}


def metric_dispatch(spark, d):
    """Each row is scored by the measure that it names."""
    rows = read(spark, d, "part").select(_case("p_partkey", list(METRICS)).alias("metric"), F.col("p_brand").alias("truth"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.concat(F.upper("p_brand"), F.lit("."))).otherwise(F.lower("p_brand")).alias("said"))
    return rounded(reports.by_metric(rows, "metric", METRICS, F.col("said"), F.col("truth")).groupBy("metric").agg(F.count("*").alias("n"), F.avg("score").alias("score")))


def sentence_overlap(spark, d):
    """GLEU and unigram recall, precision and F of benchmark items against the next but one, whole texts."""
    items = read(spark, d, "benchmark")
    rows = items.join(items.select((F.col("item_id") - 2).alias("item_id"), F.col("text").alias("other")), "item_id")
    return rounded(reports.ngram_overlap(rows, "item_id", "text", "other"))


def point_scores(spark, d):
    """tagged points against points and boxes, keypoints, and boxes of a track."""
    n, q = F.col("l_linenumber") / 8, F.col("l_quantity") / 50
    tag = lambda x, y: F.concat(F.lit("at <point>"), x, F.lit(" , "), y, F.lit("</point>"))
    said = F.when(F.col("l_linenumber") == 7, F.concat(tag(n, q), tag(n, q))).when(F.col("l_linenumber") == 6, F.lit("<point>a,b</point>")).otherwise(tag(n, q))
    xy, box = lambda x, y: F.array(x, y), lambda x, y, s: F.array(x, y, x + s, y + s)
    track = F.when(F.col("l_linenumber") == 1, F.array(box(n, q, 0.5))).otherwise(F.array(box(n, q, 0.5), box(q, n, 0.25)))
    rows = read(spark, d, "lineitem").select(
        "l_linenumber", A.point_closeness(said, tag(F.lit(0.5), F.lit(0.5))).alias("close"), A.point_in_boxes(said, F.array(box(F.lit(0.0), F.lit(0.0), 0.3), box(F.lit(0.2), F.lit(0.1), 0.4))).alias("box"),
        A.keypoint_score(F.array(xy(n, q), xy(q, n)), F.array(xy(q, q), xy(n, n))).alias("keypoints"), A.tracked_boxes_iou(track, F.array(box(q, q, 0.5), box(n, n, 0.25))).alias("track"),
    )
    return rounded(rows.groupBy("l_linenumber", "box").agg(F.count("*").alias("n"), F.avg("close").alias("close"), F.avg("keypoints").alias("keypoints"), F.avg("track").alias("track")))


_FORMULAS = ["so \\[ \\mathbf{X} = \\frac{a}{b} \\tag{1} \\]", "\\begin{array}A \\quad b\\end{array}.", "x_1 + Y"]


def document_normalisation(spark, d):
    """formulas, words alone, and full-width characters."""
    formula = F.concat(_case("p_partkey", _FORMULAS), F.when(F.col("p_partkey") % 3 == 2, F.col("p_brand")).otherwise(""))
    wide = F.translate(F.col("p_name"), "abcdefghijklmnopqrstuvwxyz ", "".join(chr(ord(x) + 0xFEE0) for x in "abcdefghijklmnopqrstuvwxyz") + "\u3000")
    said = F.concat(F.col("p_name"), F.lit("\t, "), F.col("p_brand"), F.lit(" é/n\\t图."))
    return read(spark, d, "part").select("p_partkey", O.plain_formula(formula).alias("formula"), O.bare(said).alias("bare"), O.half_width(wide).alias("narrow"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_W1 = "string_split(p_name, ' ')[1]"
def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _order_sql() -> str:
    """The same patterns, one after the other, over the same answers."""
    template = " ".join(f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate(_ORDERS))
    said = f"CASE p_partkey % {len(_ORDERS)} {template} END"
    for i in range(4):
        said = f"replace({said}, '${i + 1}', substr('ABCD', CAST((p_partkey // {len(_ORDERS)} // {4**i}) % 4 + 1 AS INTEGER), 1))"
    places = ", ".join(f"nullif(regexp_extract(up, '(?i){p}', 1), '')" for p in finals.PLACES)
    return f"""WITH s AS (SELECT p_partkey, upper({said}) up FROM part),
        f AS (SELECT p_partkey, string_split(regexp_extract(up, '{finals.WORD}', 1), '') w, list_filter([{places}], lambda x: x IS NOT NULL) p, regexp_extract_all(up, '(?i){finals.STEPS}', 1)[1:4] t FROM s),
        o AS (SELECT p_partkey, CASE WHEN len(list_distinct(w)) = 4 THEN array_to_string(w, '') WHEN len(list_distinct(p)) = 4 THEN array_to_string(p, '') WHEN len(list_distinct(t)) = 4 THEN array_to_string(t, '') END "order" FROM f)
        SELECT p_partkey, "order", CASE WHEN p_partkey % 2 = 0 THEN "order" END sorted FROM o"""


def _number_sql() -> str:
    """The same patterns over the same answers; amounts get their commas by a rule of their own."""
    price = "CAST(floor(p_retailprice * p_size * 10) AS BIGINT)"
    template = " ".join(f"WHEN {i} THEN {_sql_text(t.replace('####', '@@@@').replace('#', '{}').replace('@@@@', '####'))}" for i, t in enumerate(_SOLVED))
    said = f"replace(CASE p_partkey % {len(_SOLVED)} {template} END, '{{}}', CASE p_size % 3 WHEN 0 THEN format('{{:,}}', {price}) WHEN 1 THEN {price} || '.5' ELSE {price} || '' END)"
    value = "CASE WHEN regexp_matches(n, '^-?[0-9]+(\\.[0-9]+)?$') THEN CAST(n AS DOUBLE) WHEN regexp_matches(n, '^-?[0-9]+/[0-9]+$') THEN CAST(split_part(n, '/', 1) AS DOUBLE) / nullif(CAST(split_part(n, '/', 2) AS DOUBLE), 0) END"
    ask = lambda step, text, patterns, where="", line="0": " UNION ALL ".join(f"SELECT p_partkey, {step} step, {line} line, {i} rule, replace(regexp_extract_all({text}, '(?i){p}', 1)[-1], ',', '') n FROM {where}" for i, p in enumerate(patterns))
    return f"""WITH s AS (SELECT p_partkey, trim({said}, ' ' || chr(10)) t FROM part), l AS (SELECT p_partkey, list_reverse(string_split(t, chr(10))) x FROM s), n AS (SELECT p_partkey, i, trim(x[i]) x FROM l, range(1, 6) r(i) WHERE i <= len(x)),
        p AS (SELECT p_partkey, regexp_split_to_array(t, '\\n\\s*\\n')[-1] x FROM s), few AS (SELECT * FROM n WHERE i <= 3),
        found AS ({ask(1, "t", finals.FINAL, "s")} UNION ALL {ask(2, "x", finals.ALONE, "n", "i")} UNION ALL {ask(3, "x", finals.NEAR, "p")} UNION ALL {ask(4, "x", finals.BARE, "few", "i")}),
        v AS (SELECT *, {value} v FROM found)
        SELECT p_partkey, round(arg_min(v, (step, line, rule)) FILTER (v IS NOT NULL), 6) "number" FROM part LEFT JOIN v USING (p_partkey) GROUP BY 1"""


SQL = {
    "document_normalisation": """SELECT p_partkey, ['{x}=\\frac{a}{b}', 'ab', 'x_1+y' || lower(p_brand)][p_partkey % 3 + 1] formula, regexp_replace(p_name || p_brand, '[^a-zA-Z0-9_]', '', 'g') || 'é图' bare, p_name narrow FROM part""",
    "point_scores": """WITH r AS (SELECT l_linenumber l, CAST(l_linenumber AS DOUBLE) / 8 n, l_quantity / 50 q FROM lineitem), i AS (SELECT *, greatest(least(n, q) + 0.5 - greatest(n, q), 0) a, greatest(least(n, q) + 0.25 - greatest(n, q), 0) b FROM r),
        x AS (SELECT l, CASE WHEN l < 6 AND n BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1 THEN greatest(0, 1 - sqrt(pow(n - 0.5, 2) + pow(q - 0.5, 2))) ELSE 0 END c,
          CASE WHEN l < 6 AND n BETWEEN 0 AND 0.3 AND q BETWEEN 0 AND 0.3 THEN 0 WHEN l < 6 AND n BETWEEN 0.2 AND 0.2::DOUBLE + 0.4::DOUBLE AND q BETWEEN 0.1 AND 0.1::DOUBLE + 0.4::DOUBLE THEN 1 END b, exp(-10 * abs(n - q) / sqrt(2)) k,
          CASE WHEN l = 1 THEN 0 ELSE (a * 0.5 / (0.5 - a * 0.5) + b * 0.25 / (0.125 - b * 0.25)) / 2 END t FROM i)
        SELECT l l_linenumber, b box, count(*) n, round(avg(c), 6) "close", round(avg(k), 6) keypoints, round(avg(t), 6) track FROM x GROUP BY ALL""",
    "multi_choice_parse": f"""WITH s AS (SELECT p_partkey, p_brand, upper(p_type) t, p_name, {_sql_case('p_partkey', _CHOICES)} || CASE WHEN p_partkey % 8 = 4 THEN p_type || ' not the ' || p_brand ELSE '' END s FROM part),
        r AS (SELECT p_partkey, ' ' || trim(trim(trim(trim(trim(trim(trim(s, ','), '.'), '!'), '?'), ';'), ':'), '''') || ' ' r, [('A', p_brand), ('B', t), ('C', 'zzz'), ('E', p_name)] o FROM s),
        e AS (SELECT p_partkey, r, unnest(o) x, generate_subscripts(o, 1) i FROM r), f AS (SELECT p_partkey, r, i, x[1] k, x[2] v, '(' || x[1] || ')' m, ' ' || x[1] || ' ' w FROM e),
        g AS (SELECT *, CASE WHEN contains(r, m) OR contains(r, k || '. ') THEN CASE WHEN contains(r, m) THEN length(r) - strpos(reverse(r), reverse(m)) ELSE 0 END END a, CASE WHEN contains(r, w) THEN length(r) - strpos(reverse(r), reverse(w)) END b,
          CASE WHEN contains(lower(r), lower(v)) AND len(regexp_extract_all(r, '\\S+')) > 5 THEN length(r) - strpos(reverse(lower(r)), reverse(lower(v))) - length(v) END c FROM f)
        SELECT p_partkey, coalesce(arg_max(k, (a, -i)) FILTER (a IS NOT NULL), arg_max(k, (b, -i)) FILTER (b IS NOT NULL), arg_max(k, (c, -i)) FILTER (c IS NOT NULL)) letter FROM g GROUP BY 1""",
    "judge_replies": "SELECT p_partkey, [1, NULL, 0, NULL, NULL][p_partkey % 5 + 1] correct, CASE WHEN p_partkey % 5 = 0 THEN 'it fits' END reason FROM part".replace("[1, NULL, 0, NULL, NULL]", "[1, NULL, 0, NULL, 1]"),
    "critic_matches": "SELECT p_partkey, p_partkey % 3 = 0 AS \"right\" FROM part",
    "string_matches": f"""WITH s AS (SELECT p_partkey, {_sql_case('p_partkey', _SAID)} s, {_sql_case('(p_partkey // 8)', _TRUE)} t, p_size % 9 - 1 z FROM part),
        e AS (SELECT *, regexp_replace(lower(s), '[-. ]', '', 'g') ls, regexp_replace(lower(t), '[-. ]', '', 'g') lt FROM s),
        f AS (SELECT *, CASE WHEN regexp_full_match(t, '[A-Za-z]') AND length(s) > 1 AND regexp_matches(s, '^\\(?[A-Za-z]') THEN regexp_extract(s, '^\\(?([A-Za-z])', 1) ELSE s END = t ex,
          CASE WHEN regexp_full_match(lt, '[a-z]') AND length(ls) > 1 AND regexp_matches(ls, '^\\(?[a-z]') THEN regexp_extract(ls, '^\\(?([a-z])', 1) ELSE ls END = lt si FROM e)
        SELECT p_partkey, ex "exact", si "simple", si OR ls = '7' "any", CASE WHEN s NOT IN ('-3', '7', '0') THEN 0 WHEN CAST(s AS INTEGER) <= 0 AND z <= 0 THEN -1 ELSE CAST(CAST(s AS INTEGER) = z AS INTEGER) END number FROM f""".replace("CAST(s AS INTEGER)", "TRY_CAST(s AS INTEGER)"),
    "letter_rules": f"""WITH s AS (SELECT p_partkey, {_sql_case('p_partkey', _LETTERS)} s, {_sql_case('(p_partkey // 6)', ['A. x', 'B. y', 'C'])} a FROM part)
        SELECT p_partkey, CASE WHEN s = a THEN 1 WHEN s IN ('A', 'B. long', 'C) short', 'A. x') THEN CAST(left(s, 1) = left(a, 1) AS INTEGER) END score, ['yes', 'no', CASE WHEN false THEN '' END, 'no'][p_partkey % 4 + 1] yes_no FROM s""",
    "counting_prompts": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'objects' ELSE replace(replace(p_type, ' ', '_'), '_', ' ') END category,
        CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Count the number of ' || replace(p_type, ' ', '_') || ' in the image' END "plain" FROM part""",
    "clue_frame_sampling": """WITH s AS (SELECT p_partkey, p_partkey % 9 + 1 f, unnest([1, 2]) i, unnest([p_size, p_size * 2]) a0, unnest([p_size + 2.5, p_size * 2 + p_size / 4 + 1]) b0 FROM part),
        r AS (SELECT p_partkey, f, i, CAST(round_even(CAST(a0 * 2 AS DOUBLE), 0) AS INTEGER) a, CAST(round_even(CAST(b0 * 2 AS DOUBLE), 0) AS INTEGER) b FROM s), t AS (SELECT *, sum(b - a) OVER (PARTITION BY p_partkey) t FROM r),
        n AS (SELECT *, greatest(1, CAST(floor(f * ((b - a) / CAST(t AS DOUBLE))) AS INTEGER)) n FROM t),
        l AS (SELECT p_partkey, i, CASE WHEN f >= t THEN range(a, b) ELSE list_transform(range(n), lambda j: CAST(floor(a + (b - a) / CAST(n AS DOUBLE) / 2 + (b - a) / CAST(n AS DOUBLE) * j) AS BIGINT)) END l FROM n)
        SELECT p_partkey, array_to_string(flatten(list(l ORDER BY i)), ',') frames FROM l GROUP BY 1""",
    "answer_match_methods": f"""WITH r AS (SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) z, {_W1} w, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE upper({_W1}) END p FROM part), a AS (SELECT p_partkey, p, unnest([p_brand, z, w]) a FROM r),
        m AS (SELECT *, levenshtein(lower(a), lower(p)) / greatest(length(a), length(p) + 2) d, CASE WHEN TRY_CAST(p AS DOUBLE) IS NOT NULL AND TRY_CAST(a AS DOUBLE) <> 0 THEN abs(TRY_CAST(p AS DOUBLE) - TRY_CAST(a AS DOUBLE)) / abs(TRY_CAST(a AS DOUBLE)) <= 0.05 ELSE lower(a) = lower(p) END x FROM a),
        g AS (SELECT p_partkey, 1 - min(d) d, max(CAST(x AS DOUBLE)) x, avg(CAST(x AS DOUBLE)) y, max(CAST(lower(a) = lower(p) AS DOUBLE)) e, avg(CAST(lower(a) = lower(p) AS DOUBLE)) f FROM m GROUP BY 1),
        v AS (SELECT p_partkey, sum(least(1, (n - h) / 3)) / 3 v FROM (SELECT p_partkey, CAST(lower(a) = lower(p) AS INTEGER) h, sum(CAST(lower(a) = lower(p) AS INTEGER)) OVER (PARTITION BY p_partkey) n FROM a) GROUP BY 1)
        SELECT p_partkey, round(CASE WHEN d < 0.5 THEN 0 ELSE d END, 6) anls, x relaxed, round(y, 6) chart, e accuracy, round(f, 6) normalised, round(v, 6) vqa FROM g JOIN v USING (p_partkey)""",
    "order_answers": _order_sql(),
    "numerical_answers": _number_sql(),
    "list_answers": "SELECT p_partkey, ['a|b c', NULL, 'plain' || p_brand, '1|2.5', NULL][p_partkey % 5 + 1] strict, ['a|b c', 'x|y z', NULL, '1|2.5', NULL][p_partkey % 5 + 1] lenient FROM part",
    "json_answers": """SELECT p_partkey, ['{"x": "}"}|{"y": {"z": 1}}', '{"k": 2}', '', '', '{"t": 1}|{"u": 2}'][p_partkey % 5 + 1] objects, CASE WHEN p_partkey % 5 = 1 THEN '{"k": 2}' ELSE {s} END fenced, CASE WHEN p_partkey % 5 = 4 THEN '{"u": 2}' ELSE {s} END "after" FROM part""".replace("{s}", _sql_case("p_partkey", _TALK).replace("\n", "' || chr(10) || '")),
    "answer_helpers": """SELECT p_partkey, true "either", p_partkey % 3 <> 1 cjk, 'Options:' || chr(10) || 'A. ' || p_brand || CASE WHEN p_size > 25 THEN chr(10) || 'B. ' || p_type ELSE '' END prompt, true "contained", true spaceless,
        CASE p_partkey % 3 WHEN 0 THEN p_size * 60 + 5.5::DOUBLE WHEN 1 THEN 3600 + p_size * 60 + 30 END AS "seconds" FROM part""",
    "canonical_digests": """SELECT p_partkey, sha256('{"a":{"b":"' || p_brand || '","y":[1,2]},"z":' || p_size || '}') digest FROM part""",
    "merged_settings": """SELECT p_partkey, '{"batch":64,"model":{"lr":' || p_size || ',"name":"m"},"seed":42,"task":"' || p_brand || '"}' settings FROM part""",
    "metric_dispatch": f"""WITH r AS (SELECT {_sql_case('p_partkey', list(METRICS))} metric, p_brand t, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) || '.' ELSE lower(p_brand) END s FROM part),
        x AS (SELECT metric, CASE metric WHEN 'exact' THEN CAST(s = t AS DOUBLE) WHEN 'simple' THEN CAST(replace(lower(s), '.', '') = lower(t) AS DOUBLE) WHEN 'prefix' THEN CAST(lower(s) = lower(t) OR starts_with(lower(s), lower(t) || '.') AS DOUBLE)
          ELSE 1 - levenshtein(lower(s), lower(t)) / greatest(length(s), length(t)) END score FROM r) SELECT metric, count(*) n, round(avg(score), 6) score FROM x GROUP BY 1""",
    "sentence_overlap": r"""WITH p AS (SELECT a.item_id, regexp_extract_all(lower(a.text), '\S+') a, regexp_extract_all(lower(b.text), '\S+') b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 2),
        g AS (SELECT item_id, n, side, array_to_string(w[i : i + n - 1], ' ') g FROM (SELECT item_id, n, side, w, unnest(range(1, len(w) - n + 2)) i FROM (SELECT item_id, 1 side, a w FROM p UNION ALL SELECT item_id, 2, b FROM p), (VALUES (1), (2), (3), (4)) t(n))),
        c AS (SELECT item_id, n, g, count_if(side = 1) x, count_if(side = 2) y FROM g GROUP BY ALL), s AS (SELECT item_id, sum(least(x, y)) m, sum(x) x, sum(y) y, sum(least(x, y)) FILTER (n = 1) m1, sum(x) FILTER (n = 1) x1, sum(y) FILTER (n = 1) y1 FROM c GROUP BY 1)
        SELECT item_id, round(m / greatest(x, y), 6) gleu, round(m1 / x1, 6) recall, round(m1 / y1, 6) "precision", round(coalesce(2 * m1 / nullif(x1 + y1, 0), 0), 6) f1 FROM s""",
}
