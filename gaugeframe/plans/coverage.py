"""Reports, reshaping, validation, batching and scans that the other plans don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import denotation as D
from gaugeframe.functions import numeric as N
from gaugeframe.functions import pytext as P
from gaugeframe.operators import batching, joins, reports, reshape, sampling, spectrum, validation, vectors
from gaugeframe.operators import scores as S
from gaugeframe.operators.tables import place
from gaugeframe.sources import readers, writers

from .facts import read, rounded

c = F.col


def topview_report(spark, d):
    """A10: mean hit and mean partial match, overall and by level, of each split."""
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", c("l_linenumber").cast("string").alias("category"), (c("l_discount") >= 0.05).alias("hit"), (c("l_discount") * 10).alias("partial"))
    out = [reports.by_levels(rows, c(m), "l_returnflag", ["l_linestatus", "category"]).withColumn("measure", F.lit(m)) for m in ("hit", "partial")]
    return rounded(out[0].unionByName(out[1]).select("measure", "split", "level", "name", "n", "accuracy"))


def clue_report(spark, d):
    """Mean score of each task mode overall, by duration, domain and sub-category; a score of -1 doesn't count."""
    rows = read(spark, d, "events").select(F.element_at(F.array(*map(F.lit, ["long_acc", "clue_acc", "miou"])), (c("event_id") % 3 + 1).cast("int")).alias("mode"), N.bucket(c("value"), [10, 20, 30], ["[0, 10)", "[10, 20)", "[20, 30)", "[30, +)"]).alias("duration"), "event_type", (c("user_id") % 5).cast("string").alias("sub"), F.when(c("event_id") % 7 == 0, -1.0).otherwise(c("value") % 1).alias("score"))
    return rounded(reports.by_levels(rows.where("score <> -1"), c("score"), "mode", ["duration", "event_type", "sub"]), 4)


def box_report(spark, d):
    """Precision, mean overlap and rows of each split, and their average over the listed splits."""
    rows = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("split"), c("l_discount").alias("iou"))
    return rounded(reports.listed_splits(rows, "split", c("iou") >= 0.05, c("iou"), ["NO", "RF", "AF"]))


def step_accuracy(spark, d):
    """Mean hits of problems of one, two and three steps."""
    rows = read(spark, d, "orders").select((c("o_orderkey") % 3 + 1).alias("steps"), (c("o_custkey") % 4 != 0).alias("hit"))
    return rounded(reports.by_levels(rows, c("hit"), None, ["steps"]).where("level = 'steps'").select(c("name").alias("steps"), "n", "accuracy"))


def caption_report(spark, d):
    """Means of several measures by subject, by category and overall, as one table."""
    rows = read(spark, d, "part").select(c("p_brand").alias("subject"), F.split("p_type", " ")[0].alias("category"), c("p_size").alias("B2"), (c("p_retailprice") / 10).alias("RL"), (c("p_partkey") % 11).alias("GE"))
    return rounded(reports.merged_means(rows, "subject", "category", ["B2", "RL", "GE"]))


def value_summary(spark, d):
    """number, mean, sample deviation and standard error of each group; a group of one has no deviation."""
    return rounded(reports.value_summary(read(spark, d, "customer").withColumn("g", c("c_custkey") % 149), "g", "c_acctbal"))


def position_pairs(spark, d):
    """F64: distinct indices in order, taken two by two; an odd last one is left out."""
    return reshape.pairs_in_order(read(spark, d, "events").select("user_id"), "user_id")


def matched_boxes(spark, d):
    """The least-cost and the greedy matching of two true with two found boxes."""
    cost = F.array(F.array(c("l_extendedprice") / 1000, c("l_linenumber") * 7.0), F.array(c("l_linenumber") * 5.0, c("l_quantity") / 2))
    share = F.transform(cost, lambda r: F.transform(r, lambda x: x / 100))
    rows = read(spark, d, "lineitem").select(P.column(lambda m: P.assignment([list(r) for r in m]), "array<int>", cost)[0].alias("first"), P.column(lambda m: [j for _, j in sorted(P.greedy_matches([list(r) for r in m]))], "array<int>", share)[0].alias("greedy"))
    return rows.groupBy("first", "greedy").agg(F.count("*").alias("n"))


def located_span_scores(spark, d):
    """F36, one span each: the root of the overlap times a penalty of nothing."""
    spans = lambda a, b: F.array(F.array(a.cast("double"), b.cast("double")))
    score = P.column(lambda g, f: S.located_counts([tuple(x) for x in g], [tuple(x) for x in f]), "double", spans(c("l_linenumber"), c("l_linenumber") + 4), spans(c("l_quantity") / 10, c("l_quantity") / 10 + 3))
    return rounded(read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(score).alias("score")))


def vector_errors(spark, d):
    """mean square and its root, angles the short way round."""
    a, b = F.array(c("l_quantity"), c("l_linenumber") * 1.0), F.array(c("l_linenumber") * 6.0, c("l_linenumber") + 1.0)
    turn = N.angle_error(c("l_quantity") * 20, c("l_linenumber") * 50.0)
    return rounded(read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(N.mean_square(a, b)).alias("mse"), F.sqrt(F.avg(turn * turn)).alias("angle_rmse")))


def resize_policy(spark, d):
    """F57"""
    rows = read(spark, d, "part").select("p_partkey", N.resized(c("p_size") * 31 + 17, c("p_partkey") % 500 + 40, 980, 224, 14).alias("s"))
    return rows.select("p_partkey", "s.width", "s.height")


def box_set_overlap(spark, d):
    """the mean best overlap of two true boxes with two found ones."""
    from gaugeframe.functions.answers import box_set_iou

    box = lambda x, y, w, h: F.array(*[v.cast("double") for v in (x, y, x + w, y + h)])
    q, n = c("l_quantity"), c("l_linenumber")
    rows = read(spark, d, "lineitem").select("l_returnflag", box_set_iou(F.array(box(q, n, F.lit(10), F.lit(5)), box(n, n, F.lit(8), F.lit(8))), F.array(box(n * 5, n, F.lit(12), F.lit(4)), box(n + 1, n + 2, F.lit(8), F.lit(6)))).alias("iou"))
    return rounded(rows.groupBy("l_returnflag").agg(F.avg("iou").alias("iou")))


def validated_ids(spark, d):
    """P3, P4, P5"""
    uid = F.concat_ws("::", c("p_brand"), F.when(c("p_size") % 3 == 0, "").otherwise("test"), c("p_partkey"))
    rows = read(spark, d, "part").select("p_partkey", validation.uid_parts(uid).alias("u"), validation.binary_hit((c("p_size") % 2).cast("string")).alias("hit"), validation.typed_id(F.concat(F.lit("i2"), F.substring("p_type", 1, 1), F.lit(":x"))).alias("typed"), validation.typed_id(F.concat(F.lit("i2t:"), F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("named"))
    return rows.select("p_partkey", "u.benchmark", "u.split", c("u.index").alias("item"), "hit", "typed", "named")


def known_rows(spark, d):
    """P11"""
    return joins.known_only(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


def self_references(spark, d):
    """A short payload is the index of the row that holds the real one."""
    long = F.repeat(F.concat("p_name", F.lit(" ")), 12)
    rows = read(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 4 == 0, long).otherwise((c("p_partkey") - c("p_partkey") % 4).cast("string")).alias("image"))
    return reshape.self_reference(rows, "p_partkey", "image").select("p_partkey", F.sha2("image", 256).alias("digest"))


def preferred_order(spark, d):
    """Preferred names first, then the rest by name, with their places."""
    from pyspark.sql import Window

    names = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return names.withColumn("place", F.row_number().over(Window.orderBy(*joins.display_order(c("o_orderpriority"), ["5-LOW", "1-URGENT"]))))


def gated_epochs(spark, d):
    """Two epochs of a stream whose ungated rows stop once 200 target rows were drawn."""
    rows = read(spark, d, "orders").select("o_orderkey", (c("o_orderstatus") == "F").alias("target"))
    run = reshape.offset_running_sum(rows, F.floor(c("o_orderkey") / 1000), ["o_orderkey"], c("target").cast("int"), "drawn")
    kept = joins.gated(joins.epochs(run, 2), c("target"), c("drawn") - c("target").cast("int"), 200)
    return kept.groupBy("epoch", "target").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def fixed_batches(spark, d):
    """B2: micro-batches of a fixed number of rows a group, a group with an interval only every so many; rows of the
    longest length or more are skipped."""
    rows = read(spark, d, "orders").select("o_orderstatus", "o_orderkey", (c("o_custkey") % 100).alias("tokens"))
    plan = {"F": (4, 1, 0), "O": (2, 3, 1), "P": (1, 2, 0)}
    drawn = batching.fixed_draws(rows, "o_orderstatus", "o_orderkey", c("tokens") < 90, plan)
    return drawn.groupBy("batch").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.min("o_orderkey").alias("first"))


def patch_positions(spark, d):
    """B13"""
    rows = read(spark, d, "part").select("p_partkey", joins.patch_positions(c("p_size") * 3, (c("p_partkey") % 40).cast("int"), 14, 70).alias("p"))
    return rows.select("p_partkey", F.array_join("p", ",").alias("positions"))


def column_names(spark, d):
    """Names in lower case, but for the single letters of options."""
    rows = read(spark, d, "part").select(c("p_name").alias("Question"), c("p_brand").alias("A"), c("p_type").alias("L2-Category"), c("p_size").alias("hit"))
    return spark.createDataFrame([(i, n) for i, n in enumerate(reshape.plain_names(rows).columns)], "place int, name string")


def choice_maps(spark, d):
    """Questions without options become two options; options that exist as a map."""
    rows = read(spark, d, "part").select("p_partkey", F.when(c("p_size") > 10, c("p_brand")).alias("A"), c("p_type").alias("B"), F.when(c("p_size") > 30, c("p_name")).alias("C"), c("p_brand").alias("answer"))
    open_ = reshape.open_questions(rows, "answer")
    return open_.select("p_partkey", F.array_join(F.transform(F.map_entries(reshape.choice_map(open_.columns)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("choices"))


def original_rows(spark, d):
    """The row of the sub-dataset that a row of the union came from."""
    parts = {"customer": read(spark, d, "customer").select(c("c_custkey").alias("key"), c("c_name").alias("name")), "supplier": read(spark, d, "supplier").select(c("s_suppkey").alias("key"), c("s_name").alias("name"))}
    asked = reshape.tagged_union(parts, "SUB_DATASET").select("SUB_DATASET", c("key").alias("original_index"))
    return joins.original_rows(asked, parts, "SUB_DATASET", "original_index", "key").select("SUB_DATASET", "original_index", "name")


def episode_order(spark, d):
    """T4: places of episodes ordered as text."""
    rows = sampling.ranged(read(spark, d, "part").select("p_partkey", c("p_partkey").cast("string").alias("episode")), "episode")
    return sampling.sliced_rank(rows, [], "_piece", ["episode"], "place").select("p_partkey", "place")


def carried_results(spark, d):
    """Of several runs the newest answer of each item, for items that the newest run lacks too."""
    rows = read(spark, d, "events").select((c("event_id") % 300).alias("item"), "ts", "event_id", "value")
    new = rows.where("event_id % 2 = 0")
    return rounded(reshape.carried_over(read(spark, d, "events").select((c("event_id") % 300).alias("item")).distinct(), new, ["item"], F.struct("ts", "event_id")).select("item", "event_id", "value"))


def parameter_blocks(spark, d):
    """Parameters by module and by themselves."""
    names = ["language_model.model.layers.{}.self_attn.q_proj.weight", "language_model.model.layers.{}.input_layernorm.weight", "language_model.model.layers.{}.mlp_moe_gen.up_proj.weight", "vit_model.vision_model.encoder.layers.{}.mlp.fc1.weight", "connector.fc{}.bias", "language_model.model.layers.{}.mlp.down_proj.bias"]
    name = F.replace(F.element_at(F.array(*map(F.lit, names)), (c("p_partkey") % 6 + 1).cast("int")), F.lit("{}"), (c("p_partkey") % 30).cast("string"))
    rows = read(spark, d, "part").select(name.alias("name")).distinct().withColumn("module", vectors.module_of(c("name"))).where("module IS NOT NULL")
    return vectors.blocks_of(rows).groupBy("module", "parameter").agg(F.count("*").alias("n"))


def structural_zeros(spark, d):
    """V14"""
    rows = read(spark, d, "embeddings").withColumn("embedding", F.when(c("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(c("embedding")))
    return vectors.zero_rows(rows, "embedding").select("vec_id", "label")


def jsonl_round_trip(spark, d):
    """Gzipped JSON lines written and read with their schema."""
    path = place(spark)
    read(spark, d, "conversations").write.option("compression", "gzip").json(path)
    return readers.json_lines(spark, path, "conv_id long, turn long, role string, text string")


def manifest_digest(spark, d):
    """K1, H3: count and digest of a manifest's ordered uids."""
    rows = read(spark, d, "documents").select((-c("doc_id")).alias("ordinal"), F.concat(F.lit("d"), c("doc_id")).alias("uid"))
    return writers.manifest(rows, place(spark)).select("count", "ordered_uid_sha256")


def manifest_order(spark, d):
    """The written order of a manifest, taken from its files."""
    path = place(spark)
    writers.manifest(read(spark, d, "part").select(((c("p_partkey") * 7919) % 100_003).alias("ordinal"), F.concat(F.lit("p"), c("p_partkey")).alias("uid")), path)
    return readers.manifest(spark, f"{path}/rows", "uid string").select("uid", c("ordinal").cast("int").alias("place"))


def content_places(spark, d):
    """K6, H5: each distinct content once, with its place."""
    return writers.content_store(read(spark, d, "documents").where("text IS NOT NULL").select(c("text").cast("binary").alias("bytes")), "bytes").select("path", F.octet_length("content").cast("long").alias("bytes"))


def group_files(spark, d):
    """A folder of tab-separated files a group, read back by suffix."""
    path = place(spark)
    writers.by_group(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", path)
    tsv = f"{place(spark)}.tsv"
    writers.dump(spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n")), tsv)
    return readers.load(spark, tsv).select("c_mktsegment", c("n").cast("long").alias("n"))


def score_sheets(spark, d):
    """A sheet written as CSV and read as text, with its options."""
    path = f"{place(spark)}.csv"
    rows = read(spark, d, "part").select(F.concat(c("p_partkey"), F.lit(".0")).alias("index"), (c("p_size") % 2).alias("hit"), F.concat(F.lit("  "), c("p_name")).alias("question"), F.lit("A").alias("answer"), c("p_brand").alias("A"), F.when(c("p_size") > 25, c("p_type")).alias("B"))
    writers.dump(rows, path)
    return readers.score_sheet(spark, path).select("index", c("hit").cast("int").alias("hit"), "question", F.array_join(F.array_sort(F.map_values("options")), "|").alias("options"))


def checked_shards(spark, d):
    """Shards with their digests and count checked, two columns read."""
    path = place(spark)
    read(spark, d, "orders").repartition(3).write.parquet(path)
    known = {r["path"].rpartition("/")[2]: r["sha256"] for r in readers.file_digests(spark, path).collect()}
    rows = readers.shards(spark, [path], ["o_orderkey", "o_orderstatus"], "o_orderkey", read(spark, d, "orders").count(), known)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def frozen_selection(spark, d):
    """Rows of a selection whose ids have the right form, found again by their canonical digest."""
    rows = read(spark, d, "part").select(F.concat(F.lit("p_"), c("p_partkey")).alias("id"), F.to_json(F.struct(c("p_size").alias("b"), c("p_brand").alias("a"))).alias("record"))
    wanted = rows.where(F.get_json_object("record", "$.b").cast("int") > 40).select("id", F.sha2(P.column(P.canonical_json, "string", c("record")), 256).alias("digest"))
    return readers.selected(rows, "record", readers.frozen(wanted, "id", r"p_\d+", wanted.count()), "digest").select("id", "digest")


def frame_samples(spark, d):
    """S15"""
    rows = read(spark, d, "part").withColumn("frames", c("p_size") * 13)
    return rows.select("p_partkey", F.array_join(readers.frame_indices("frames", 4), ",").alias("even"))


def denotation_matches(spark, d):
    """lists of answers by what they denote, amounts by any reading."""
    truth = F.concat(c("p_size"), F.lit("|"), c("p_brand"))
    found = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("“"), F.lower("p_brand"), F.lit("” (a brand)|"), c("p_size"), F.lit(".0"))).when(c("p_partkey") % 3 == 1, F.concat(c("p_size"), F.lit("|"), c("p_size"))).otherwise(c("p_size").cast("string"))
    said = F.concat(F.lit("$"), c("p_size"), F.element_at(F.array(*map(F.lit, [" million dollars", "%", " shares", " thousand"])), (c("p_partkey") % 4 + 1).cast("int")))
    same = P.column(lambda a, b: D.same_denotation(D.unescaped(a), D.unescaped(b)), "boolean", truth.cast("string"), found.cast("string"))
    return read(spark, d, "part").select("p_partkey", same.alias("same"), P.column(D.same_amount, "boolean", c("p_size").cast("string"), said).alias("bare"), P.column(D.same_amount, "boolean", (c("p_size") * 1000).cast("string"), said).alias("thousands"))


def puzzle_rules(spark, d):
    """a sudoku by its rules, four numbers that make 24, and a ladder of words."""
    base = [[(3 * r + r // 3 + k) % 9 + 1 for k in range(9)] for r in range(9)]
    solved, swapped = str(base), str([base[1], base[0], *base[2:]])
    broken = str([[base[0][1], base[0][0], *base[0][2:]], *base[1:]])
    given = str([[x if (r + k) % 2 else 0 for k, x in enumerate(row)] for r, row in enumerate(base)])
    grid = F.element_at(F.array(*map(F.lit, [solved, swapped, broken])), (c("p_partkey") % 3 + 1).cast("int"))
    text = F.concat_ws(" ", F.concat(c("p_size"), F.lit(" * 1")), F.lit("+ ("), F.lit(24) - c("p_size"), F.lit(")"))
    made = P.column(lambda n, t: D.makes([n, 1, abs(24 - n)], t), "boolean", c("p_size"), text)
    ladder = P.column(lambda s: D.word_ladder("cold", "warm", list(s)), "boolean", F.when(c("p_partkey") % 2 == 0, F.array(*map(F.lit, ["cold", "cord", "word", "ward", "warm"]))).otherwise(F.array(*map(F.lit, ["cold", "warm"]))))
    return read(spark, d, "part").select("p_partkey", P.column(lambda a: D.sudoku(given, a), "boolean", grid).alias("sudoku"), made.alias("made"), ladder.alias("ladder"))


def depth_images(spark, d):
    """rows of pixels stretched between quantiles, and between least and greatest."""
    rows = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000, 0)).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)
    return rows.select("vec_id", total(N.stretched(c("p"), 0.02, 0.98, 65535.0)).alias("depth"), total(N.stretched(c("p"))).alias("plain"))


def attention_spans(spark, d):
    """B14"""
    mode = F.when(c("role") == "assistant", "full").when(c("turn") % 3 == 1, "noise").otherwise("causal")
    splits = read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 50 + 1).alias("n"), mode.alias("mode"))
    return batching.attended(splits, "conv_id", "turn", "n", "mode")


def base64_contents(spark, d):
    """S12"""
    rows = read(spark, d, "part").select("p_partkey", F.base64(F.col("p_name").cast("binary")).alias("image"))
    return writers.localised(rows, "p_partkey", "image").select("p_partkey", "path", F.octet_length("content").alias("bytes"))


def seeded_pool(spark, d):
    """The first rows of a seeded shuffle, with their places."""
    rows = read(spark, d, "part").select("p_partkey", "p_name")
    return readers.shuffled_take(rows, "p_partkey", rows.count(), 50, 20260826).select("p_partkey", "p_name", "place")


def seeded_prompts(spark, d):
    """H8: the wording that each seed picks."""
    return read(spark, d, "part").select("p_partkey", P.column(P.seeded_choice, "string", c("p_partkey"), F.array(*map(F.lit, ["Count them.", "How many are there?", "Give the number."]))).alias("prompt"))


def artifact_round_trip(spark, d):
    """Gradient rows and vectors stored, checked and read back."""
    path, rows = place(spark), read(spark, d, "embeddings")
    meta = rows.select(c("vec_id").alias("uid"), (c("vec_id") % 5).alias("fold"), (c("vec_id") / 7).alias("loss"), (c("vec_id") % 11 + 1).alias("loss_tokens"))
    half = lambda name, at: rows.select(c("vec_id").alias("uid"), F.lit(name).alias("name"), F.slice("embedding", at, 32).alias("values"))
    writers.artifact(meta, half("first", 1).unionByName(half("second", 33)), path)
    got = readers.artifact(spark, path).select("fold", "name", F.aggregate("values", F.lit(0.0), lambda n, x: n + x.cast("double")).alias("s"))
    return rounded(got.groupBy("fold", "name").agg(F.count("*").alias("n"), F.sum("s").alias("total")))


def projected_cosines(spark, d):
    """Cosines of pairs in the basis of the other folds, by label."""
    rows = read(spark, d, "embeddings").withColumns({"pair": F.floor(c("vec_id") / 2), "fold": F.floor(c("vec_id") / 2) % 5, "objective": F.when(c("vec_id") % 2 == 0, "i2i").otherwise("i2t")})
    return rounded(spectrum.projected_pairs(rows, "embedding", "fold", ["objective"], 5, "pair", "objective"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

SQL = {
    "topview_report": """WITH r AS (SELECT l_returnflag s, l_linestatus a, CAST(l_linenumber AS VARCHAR) b, unnest(['hit', 'partial']) k, unnest([CAST(l_discount >= 0.05 AS DOUBLE), l_discount * 10]) m FROM lineitem),
        x AS (SELECT k, s, 'Overall' l, 'Overall' n, m FROM r UNION ALL SELECT k, s, 'l_linestatus', a, m FROM r UNION ALL SELECT k, s, 'category', b, m FROM r)
        SELECT k measure, s split, l "level", n "name", count(*) n, round(avg(m), 6) accuracy FROM x GROUP BY k, s, l, x.n""",
    "clue_report": """WITH r AS (SELECT ['long_acc', 'clue_acc', 'miou'][event_id % 3 + 1] s, CASE WHEN value <= 10 THEN '[0, 10)' WHEN value <= 20 THEN '[10, 20)' WHEN value <= 30 THEN '[20, 30)' ELSE '[30, +)' END a, event_type b, CAST(user_id % 5 AS VARCHAR) e, value % 1 m FROM events WHERE event_id % 7 <> 0),
        x AS (SELECT s, 'Overall' l, 'Overall' k, m FROM r UNION ALL SELECT s, 'duration', a, m FROM r UNION ALL SELECT s, 'event_type', b, m FROM r UNION ALL SELECT s, 'sub', e, m FROM r)
        SELECT s split, l "level", k "name", count(*) n, round(avg(m), 4) accuracy FROM x GROUP BY ALL""",
    "box_report": """WITH s AS (SELECT l_returnflag || l_linestatus split, 100 * avg(CAST(l_discount >= 0.05 AS INTEGER)) p, avg(l_discount) i, count(*) n FROM lineitem GROUP BY 1)
        SELECT split, round(p, 6) "precision", round(i, 6) mean_iou, n samples FROM s UNION ALL SELECT 'Average', round(avg(p), 6), round(avg(i), 6), CAST(sum(n) AS BIGINT) FROM s WHERE split IN ('NO', 'RF', 'AF')""",
    "step_accuracy": "SELECT CAST(o_orderkey % 3 + 1 AS VARCHAR) steps, count(*) n, round(avg(CAST(o_custkey % 4 <> 0 AS INTEGER)), 6) accuracy FROM orders GROUP BY 1",
    "caption_report": """WITH r AS (SELECT p_brand s, string_split(p_type, ' ')[1] k, p_size a, p_retailprice / 10 b, p_partkey % 11 e FROM part), x AS (SELECT s, a, b, e FROM r UNION ALL SELECT 'CATEGORY_' || k, a, b, e FROM r UNION ALL SELECT 'Overall', a, b, e FROM r)
        SELECT s subject, round(avg(a), 6) "B2", round(avg(b), 6) "RL", round(avg(e), 6) "GE" FROM x GROUP BY 1""",
    "value_summary": "SELECT c_custkey % 149 g, count(*) n, round(avg(c_acctbal), 6) mean, round(stddev_samp(c_acctbal), 6) sample_std, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) sem FROM customer GROUP BY 1",
    "position_pairs": """WITH r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 i FROM (SELECT DISTINCT user_id FROM events)) SELECT CAST(a.i // 2 AS INTEGER) pair, a.user_id front, b.user_id back FROM r a JOIN r b ON b.i = a.i + 1 WHERE a.i % 2 = 0""",
    "matched_boxes": """WITH r AS (SELECT l_extendedprice / 1000 a, l_linenumber * 7.0::DOUBLE b, l_linenumber * 5.0::DOUBLE c, l_quantity / 2 d FROM lineitem)
        SELECT CASE WHEN a + d <= b + c THEN 0 ELSE 1 END "first", CASE WHEN greatest(a, b, c, d) IN (a, d) AND (greatest(a, b, c, d) = a OR greatest(b, c) < d) THEN 0 ELSE 1 END greedy, count(*) n FROM r GROUP BY 1, 2""",
    "located_span_scores": """WITH r AS (SELECT l_returnflag, l_linenumber a, l_linenumber + 4 b, l_quantity / 10 u, l_quantity / 10 + 3 v FROM lineitem)
        SELECT l_returnflag, round(avg(sqrt(greatest(0, least(b, v) - greatest(a, u)) / (greatest(b, v) - least(a, u)))), 6) score FROM r GROUP BY 1""",
    "vector_errors": """WITH r AS (SELECT l_returnflag, (pow(l_quantity - l_linenumber * 6, 2) + 1) / 2 m, abs(l_quantity * 20 - l_linenumber * 50) % 360 t FROM lineitem) SELECT l_returnflag, round(avg(m), 6) mse, round(sqrt(avg(pow(least(t, 360 - t), 2))), 6) angle_rmse FROM r GROUP BY 1""",
    "resize_policy": """WITH r AS (SELECT p_partkey, p_size * 31 + 17 w, p_partkey % 500 + 40 h FROM part), s AS (SELECT *, greatest(least(980::DOUBLE / greatest(w, h), 1), 224::DOUBLE / least(w, h)) k FROM r)
        SELECT p_partkey, greatest(14, CAST(round(w * k / 14) * 14 AS INTEGER)) width, greatest(14, CAST(round(h * k / 14) * 14 AS INTEGER)) height FROM s""",
    "box_set_overlap": """WITH r AS (SELECT row_number() OVER () id, l_returnflag f, l_quantity q, CAST(l_linenumber AS DOUBLE) n FROM lineitem),
        t AS (SELECT id, f, q, n, unnest([1, 2]) k, unnest([q, n]) x, n y, unnest([10, 8]) w, unnest([5, 8]) h FROM r), p AS (SELECT *, unnest([n * 5, n + 1]) u, unnest([n, n + 2]) v, unnest([12, 8]) g, unnest([4, 6]) j FROM t),
        i AS (SELECT *, greatest(least(x + w, u + g) - greatest(x, u), 0) * greatest(least(y + h, v + j) - greatest(y, v), 0) i FROM p), b AS (SELECT id, f, k, max(i / (w * h + g * j - i)) b FROM i GROUP BY ALL) SELECT f l_returnflag, round(avg(b), 6) iou FROM b GROUP BY 1""",
    "validated_ids": """SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand END benchmark, CASE WHEN p_size % 3 <> 0 THEN 'test' END split, CASE WHEN p_size % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) END item, CAST(p_size % 2 AS TINYINT) hit, left(p_type, 1) IN ('i', 't') typed, true "named" FROM part""",
    "known_rows": "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)",
    "self_references": "SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN sha256(CAST(a.p_partkey - a.p_partkey % 4 AS VARCHAR)) ELSE sha256(repeat(b.p_name || ' ', 12)) END digest FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 4",
    "preferred_order": "SELECT o_orderpriority, n, CAST(row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) AS INTEGER) place FROM (SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1)",
    "gated_epochs": """WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' t, sum(CAST(o_orderstatus = 'F' AS INTEGER)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM orders)
        SELECT CAST(e AS INTEGER) epoch, t target, count(*) n, max(o_orderkey) "last" FROM r, range(2) x(e) WHERE t OR coalesce(b, 0) < 200 GROUP BY e, t""",
    "fixed_batches": """WITH r AS (SELECT o_orderstatus s, o_orderkey k, o_custkey % 100 n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 i FROM orders WHERE o_custkey % 100 < 90),
        b AS (SELECT *, CASE s WHEN 'F' THEN i // 4 WHEN 'O' THEN i // 2 * 3 + 1 ELSE i * 2 END b FROM r) SELECT b batch, count(*) "rows", CAST(sum(n) AS BIGINT) tokens, min(k) "first" FROM b GROUP BY 1""",
    "patch_positions": """WITH r AS (SELECT p_partkey, p_size * 3 // 14 w, (p_partkey % 40) // 14 h FROM part), x AS (SELECT p_partkey, a * 70 + b v FROM r, range(3) y(a), range(20) z(b) WHERE a < h AND b < w)
        SELECT p.p_partkey, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') positions FROM part p LEFT JOIN x USING (p_partkey) GROUP BY 1""",
    "column_names": "SELECT * FROM (VALUES (0, 'question'), (1, 'A'), (2, 'l2-category'), (3, 'hit')) v(place, \"name\")",
    "choice_maps": "SELECT p_partkey, 'A=' || p_brand || ';B=' || CASE WHEN p_size > 10 THEN p_type ELSE 'Other Answers' END || CASE WHEN p_size > 30 THEN ';C=' || p_name ELSE '' END choices FROM part",
    "original_rows": "SELECT 'customer' \"SUB_DATASET\", c_custkey original_index, c_name \"name\" FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier",
    "episode_order": "SELECT p_partkey, CAST(row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) - 1 AS INTEGER) place FROM part",
    "carried_results": """WITH i AS (SELECT DISTINCT event_id % 300 item FROM events), n AS (SELECT event_id % 300 item, event_id, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) = 1)
        SELECT item, event_id, round(value, 6) value FROM i LEFT JOIN n USING (item)""",
    "parameter_blocks": """WITH r AS (SELECT DISTINCT p_partkey % 6 k, p_partkey % 30 l FROM part WHERE p_partkey % 6 NOT IN (2, 5)), n AS (SELECT CASE k WHEN 0 THEN 'llm.self_attn.q_proj.weight' WHEN 1 THEN 'llm.input_ln.weight' WHEN 3 THEN 'vit.mlp.fc1.weight' ELSE 'connector.fc' || l || '.bias' END m,
        CASE k WHEN 0 THEN 'language_model.model.layers.' || l || '.self_attn.q_proj.weight' WHEN 1 THEN 'language_model.model.layers.' || l || '.input_layernorm.weight' WHEN 3 THEN 'vit_model.vision_model.encoder.layers.' || l || '.mlp.fc1.weight' ELSE 'connector.fc' || l || '.bias' END p FROM r)
        SELECT m "module", NULL parameter, count(*) n FROM n GROUP BY m UNION ALL SELECT m, p, count(*) FROM n GROUP BY m, p""",
    "structural_zeros": "SELECT vec_id, label FROM embeddings WHERE vec_id % 9 = 0",
    "jsonl_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "manifest_digest": "SELECT count(*) \"count\", sha256(string_agg('d' || doc_id, chr(10) ORDER BY -doc_id) || chr(10)) ordered_uid_sha256 FROM documents",
    "manifest_order": "SELECT 'p' || p_partkey uid, CAST(row_number() OVER (ORDER BY p_partkey * 7919 % 100003) - 1 AS INTEGER) place FROM part",
    "content_places": "SELECT DISTINCT left(sha256(text), 2) || '/' || sha256(text) \"path\", strlen(text) bytes FROM documents WHERE text IS NOT NULL",
    "group_files": "SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1",
    "score_sheets": "SELECT CAST(p_partkey AS VARCHAR) \"index\", CAST(p_size % 2 AS INTEGER) hit, trim(p_name) question, CASE WHEN p_size > 25 THEN CASE WHEN p_brand < p_type THEN p_brand || '|' || p_type ELSE p_type || '|' || p_brand END ELSE p_brand END options FROM part",
    "checked_shards": "SELECT o_orderstatus, count(*) n, CAST(sum(o_orderkey) AS BIGINT) \"keys\" FROM orders GROUP BY 1",
    "frozen_selection": "SELECT 'p_' || p_partkey id, sha256('{\"a\":\"' || p_brand || '\",\"b\":' || p_size || '}') digest FROM part WHERE p_size > 40",
    "denotation_matches": """SELECT p_partkey, p_partkey % 3 = 0 same, true AS bare, (p_partkey % 4 = 3) thousands FROM part""",
    "puzzle_rules": "SELECT p_partkey, p_partkey % 3 = 0 sudoku, p_size <= 24 AS made, p_partkey % 2 = 0 ladder FROM part",
    "depth_images": """WITH e AS (SELECT vec_id, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000, 0) AS DOUBLE) x FROM embeddings), q AS (SELECT vec_id, quantile_cont(x, 0.02) lo, quantile_cont(x, 0.98) hi, min(x) a, max(x) b FROM e GROUP BY 1)
        SELECT vec_id, CAST(sum(CAST(floor(greatest(0, least(1, (x - lo) / (hi - lo))) * 255) AS INTEGER)) AS INTEGER) depth, CAST(sum(CAST(floor((x - a) / (b - a) * 255) AS INTEGER)) AS INTEGER) plain FROM e JOIN q USING (vec_id) GROUP BY 1""",
    "attention_spans": """WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'full' WHEN turn % 3 = 1 THEN 'noise' ELSE 'causal' END m, length(text) % 50 + 1 n FROM conversations), a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) e FROM s)
        SELECT q.conv_id, CAST(q.e - q.n AS INTEGER) q_start, q.e q_end, CAST(k.e - k.n AS INTEGER) k_start, k.e k_end, q.turn = k.turn AND q.m = 'causal' causal FROM a q JOIN a k ON q.conv_id = k.conv_id AND (q.turn = k.turn OR (k.turn < q.turn AND k.m <> 'noise'))""",
    "base64_contents": "SELECT p_partkey, left(sha256(p_name), 2) || '/' || sha256(p_name) \"path\", strlen(p_name) bytes FROM part",
    "artifact_round_trip": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) i, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings), s AS (SELECT vec_id, CASE WHEN i <= 32 THEN 'first' ELSE 'second' END "name", sum(v) s FROM x GROUP BY ALL)
        SELECT vec_id % 5 fold, "name", count(*) n, round(sum(s), 6) total FROM s GROUP BY ALL""",
    "frame_samples": "SELECT p_partkey, array_to_string([(i * p_size * 13) // 5 FOR i IN [1, 2, 3, 4]], ',') even FROM part",
}
