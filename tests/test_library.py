"""Hand-computed values, exhaustive small cases and guards."""

import functools
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import hashing, numeric, pytext, stats, text
from gaugeframe.operators import batching, judging, reports, reshape, sampling, scores, spectrum, transfer, validation, vectors
from gaugeframe.sources import readers, writers

HITS = {42: ([0, 0, 0], [1, 0, 1]), 43: ([1, 1, 1], [1, 0, 1]), 44: ([0, 1, 0], [1, 1, 1])}


def facts(spark, seeds):
    rows = [(f"q{q}", "Bench", "REC", "A", m, s, hits[q]) for s in seeds for m, hits in zip(("baseline", "source"), HITS[s]) for q in range(3)]
    return spark.createDataFrame(rows, "uid string, benchmark string, family string, capability string, model string, seed int, hit int")


def cell(df, **at):
    return df.where(" AND ".join(f"{k} = '{v}'" for k, v in at.items())).collect()


def test_transfer_golden(spark):
    one = transfer.summary(transfer.per_seed(facts(spark, [42]), "baseline"))
    r = cell(one, scope="ALL", level="capability", model="source")[0]
    assert r.accuracy_mean == pytest.approx(200 / 3) and r.gain_mean == pytest.approx(200 / 3) and r.gain_std is None and r.accuracy_sem is None
    cells = transfer.per_seed(facts(spark, [42, 43, 44]), "baseline")
    r = cell(transfer.summary(cells), scope="ALL", level="capability", model="source")[0]
    assert r.accuracy_mean == pytest.approx(700 / 9) and r.gain_mean == pytest.approx(100 / 3)
    gains = {x.seed: x.gain for x in cell(cells, scope="ALL", level="capability", model="source")}
    assert gains == {42: pytest.approx(200 / 3), 43: pytest.approx(-100 / 3), 44: pytest.approx(200 / 3)}
    tests = transfer.paired_tests(transfer.difference_counts(facts(spark, [42, 43, 44]), "baseline"))
    assert cell(tests, scope="ALL", level="capability", model="source")[0].p == 0.5


def test_sign_swaps_by_enumeration():
    for n1, n2, n3 in itertools.product(range(4), repeat=3):
        w = [1] * n1 + [2] * n2 + [3] * n3
        sums = [abs(sum(s * x for s, x in zip(signs, w))) for signs in itertools.product((1, -1), repeat=len(w))]
        for o in range(sum(w) % 2, sum(w) + 1, 2):
            assert stats.sign_swap_tail(n1, n2, n3, o) == (sum(x >= o for x in sums), 2 ** len(w))
    assert stats.exact_row(5, 0, 0, 5)[2:] == (0.0625, False) and stats.exact_row(6, 0, 0, -6)[2:] == (0.03125, True)
    for bad in ((1, 0, 0, 3), (1, 0, 0, 0), (-1, 0, 0, 0)):
        with pytest.raises(ValueError):
            stats.sign_swap_tail(*bad)


def test_exact_numbers_of_any_length():
    num, den, p, significant = stats.exact_row(20_000, 0, 0, 300)
    mod = lambda text: functools.reduce(lambda a, c: (10 * a + int(c)) % 1_000_003, text, 0)
    want = 2 * sum(itertools.accumulate(range(9_850), lambda c, i: c * (20_000 - i) // (i + 1), initial=1))
    assert mod(num) == want % 1_000_003 and mod(den) == pow(2, 20_000, 1_000_003) and len(den) == 6021
    assert p == want / 2**20_000 and significant == (20 * want < 2**20_000)


def test_tails_from_the_middle():
    """Lengths near those where the count starts in the middle, against the coefficients themselves."""
    for n1, n2, n3 in ((40, 3, 61), (41, 4, 62), (80, 0, 21), (1, 30, 40), (0, 0, 90), (0, 31, 0), (200, 0, 0), (0, 0, 91)):
        coefficients = [1]
        for w in [1] * n1 + [2] * n2 + [3] * n3:
            coefficients = [a + b for a, b in zip(coefficients + [0] * w, [0] * w + coefficients, strict=True)]
        weight = n1 + 2 * n2 + 3 * n3
        for o in range(2 - weight % 2, weight + 1, 2):
            tail = 2 * sum(coefficients[: (weight - o) // 2 + 1])
            assert stats.sign_swap_tail(n1, n2, n3, o) == (tail, 2 ** (n1 + n2 + n3))
            assert stats.exact_row(n1, n2, n3, o)[2] == tail / 2 ** (n1 + n2 + n3)


def test_tail_of_very_many_questions():
    """Of n threes all but the sums of 0 reach 6. One coefficient at a time took 54 s for 400,000 of them."""
    n, prime, began = 600_000, 2**61 - 1, time.process_time()
    num, den = stats.sign_swap_tail(0, 0, n, 6)
    assert time.process_time() - began < 40
    centre = functools.reduce(lambda c, k: c * (4 * k - 2) * pow(k, -1, prime) % prime, range(1, n // 2 + 1), 1)
    assert int(den) == 2**n and int(num) % prime == (pow(2, n, prime) - centre) % prime


def test_matrix_of_many_questions(spark):
    facts = spark.range(15_000).select(F.col("id").alias("uid"), F.lit("b").alias("benchmark"), F.lit("f").alias("family"), F.lit("c").alias("capability"), F.explode(F.array(F.lit("baseline"), F.lit("m"))).alias("model"))
    facts = facts.withColumns({"seed": F.lit(42), "hit": (F.col("model") == "m").cast("int")})
    tests = transfer.paired_tests(transfer.difference_counts(facts, "baseline"))
    row = transfer.matrix(transfer.per_seed(facts, "baseline"), tests, "baseline").collect()
    assert [(r.gain_mean, r.p, r.significant) for r in row] == [(100.0, 0.0, True)]


def test_least_cost_ties():
    assert pytext.assignment([[11.5, 7.0], [5.0, 0.5]]) == [0, 1] and pytext.assignment([[0.0, 0.0], [0.0, 0.0]]) == [0, 1]
    rng = np.random.default_rng(5)
    for n, m in ((2, 2), (3, 3), (2, 4), (4, 4)):
        for _ in range(40):
            cost = (rng.integers(0, 3, (n, m)) / 2).tolist()
            assert tuple(pytext.assignment(cost)) == min(itertools.permutations(range(m), n), key=lambda p: (sum(cost[i][j] for i, j in enumerate(p)), p))
    assert pytext.assignment([[1.0, float("inf")], [1.0, 5.0]]) == [0, 1] and pytext.assignment([[float("inf"), 9.0], [float("inf"), 0.1]]) == [0, 1]


def test_quantile_adds_shares_as_duckdb(spark):
    import duckdb

    x = np.random.default_rng(6).integers(-3000, 3000, (200, 64)).astype(float).tolist()
    rows = spark.createDataFrame([(r,) for r in x], "x array<double>")
    got = rows.select(*[numeric.quantile(F.array_sort("x"), q).alias(n) for q, n in ((0.02, "a"), (0.98, "b"))]).collect()
    want = [duckdb.sql(f"SELECT quantile_cont(x, 0.02), quantile_cont(x, 0.98) FROM (SELECT unnest({r}::DOUBLE[]) x)").fetchall()[0] for r in x]
    assert [tuple(r) for r in got] == want
    assert spark.range(1).select(numeric.quantile(F.array().cast("array<double>"), 0.5).alias("x")).first().x is None


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    index = {"001": "001", "1.0": "1", "1.00": "1.00", "-2.0": "-2", "NA": "NA"}
    assert {k: one(spark, text.normal_index(lit(k))) for k in index} == index
    options = {"A": lit("red car"), "B": lit("blue van")}
    said = {"The answer is (B).": "B", "it is a RED CAR": "A", "A and B": None, "B is what one may see here, they say": None, "Sorry, I can't help with images of people yet.": "Z", "Z": "Z", text.FAILURE: None}
    assert {k: one(spark, text.infer(lit(k), options)) for k in said} == said
    assert one(spark, text.relaxed_match(lit("0"), lit("0.0"))) is False and one(spark, text.relaxed_match(lit("50%"), lit("0.52"))) is True
    assert one(spark, text.anls_distance(lit(""), lit(""))) == 0 and one(spark, text.clock_seconds(lit("01:02:03.5"))) == 3723.5
    assert one(spark, text.yes_no(lit("Yes, no?"))) == "Unknown" and one(spark, text.first_yes_no(lit("nope; yes"))) == 1
    assert one(spark, text.option_letter(lit("The best answer is C"))) == "C" and one(spark, text.fenced_json(lit('x ```json\n{"a":1}\n```'))) == '{"a":1}'


def test_python_text():
    assert pytext.vqa_scores(["two"], "2") == [0.0] and pytext.vqa_scores(["2", "two", "a 2", "3"], "two") == [2 / 3, 2 / 3, 2 / 3, 1.0]
    assert pytext.plain_answer("The dog, isnt it?") == "dog isn't it"
    assert [pytext.spoken_number(t) for t in ("twenty one", "three hundred and five", "one or 2", "none here")] == [21, 305, None, None]
    assert pytext.damerau("ca", "abc") == 2 and pytext.damerau("", "ab") == 2 and pytext.near_match("abcdefghij", "abcdefghji")
    assert pytext.json_objects('a {"x": "}"} b {"y": {"z": 1}}') == ['{"x": "}"}', '{"y": {"z": 1}}']
    assert pytext.bleu("a b c d e".split(), "a b c d e".split()) == 1
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (2, 5), (4, 4)):
        cost = rng.random((n, m)).tolist()
        best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i][j] for i, j in enumerate(pytext.assignment(cost))) == pytest.approx(best)
    assert pytext.greedy_matches([[0.9, 0.8], [0.85, 0.1]]) == [(0, 0), (1, 1)]


def test_numeric(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, numeric.box_iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    spans = lambda *v: F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for a, b in v])
    assert one(spark, numeric.spans_iou(spans((0, 2), (1, 3)), spans((2, 4)))) == pytest.approx(1 / 4)
    words = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, numeric.common_prefix_ratio(words("a", "b"), words("a", "c", "d"))) == pytest.approx(1 / 3)
    assert one(spark, numeric.mean_relative_accuracy(F.lit(10.0), F.lit(10.0))) == 1.0
    assert one(spark, numeric.bucket(F.lit(10), [10, 20], ["x", "y"])) == "x"


def test_stable_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7:abc").digest()[:8], "little") % (2**63 - 1)
    assert one(spark, hashing.stable_seed(7, F.lit("abc"))) == want


def test_reports(spark):
    rows = spark.createDataFrame([(0, "A", 1, "COCO"), (1, "A", 1, "COCO"), (2, "A", 1, "COCO"), (3, "A", 0, "ADE20K")], "index int, split string, hit int, source string")
    assert reports.macro(rows, F.col("hit"), "source").first().accuracy == 0.5
    assert {r.name: r.accuracy for r in reports.by_levels(rows, F.col("hit"), "split", ["source"]).collect()} == {"Overall": 0.75, "COCO": 1.0, "ADE20K": 0.0}
    pairs = reports.all_correct(spark.createDataFrame([(1, True), (1, True), (2, True)], "g int, h boolean"), F.col("h"), ["g"], least=2)
    assert {r.g: r.hit for r in pairs.collect()} == {1: True, 2: False}
    wide = spark.createDataFrame([("test", 0.5, float("nan"))], "split string, Overall double, category double")
    assert [tuple(r) for r in reports.flatten_metrics(wide, "split", ["Overall", "category"]).collect()] == [("split=test|Overall", 0.5)]
    with pytest.raises(Exception, match="infinite"):
        reports.flatten_metrics(spark.createDataFrame([("t", float("inf"))], "split string, m double"), "split", ["m"]).collect()


def test_validation(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "y"), (3, "z")], "k int, v string")
    assert [tuple(r) for r in validation.coverage(a, b, ["k"]).collect()] == [(3, "extra")]
    assert [tuple(r) for r in validation.drift(a, b, ["k"], ["v"]).collect()] == [(1, "v", "x", "y")]
    with pytest.raises(Exception, match="not a hit"):
        a.select(validation.binary_hit(F.lit("2"))).collect()
    assert one(spark, validation.uid_parts(F.lit("B::test::01"))["index"]) == "01" and one(spark, validation.uid_parts(F.lit("B::01"))) is None
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "user", "<image><image>"), (4, 1, "assistant", "x")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id for r in validation.conversations(talk).collect()} == {2, 3, 4}


def test_sampling(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)], "a int, b int")
    roots = {r.node: r.root for r in sampling.components(edges, "a", "b").collect()}
    assert {roots[i] for i in range(61)} == {0} and roots[102] == 100 and roots[200] == 200
    tied = sampling.average_rank(spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int"), "v", "r")
    assert sorted(r.r for r in tied.collect()) == [0, 1.5, 1.5, 3]
    run = reshape.offset_running_sum(spark.range(100).withColumn("v", F.lit(1)), F.floor(F.col("id") / 7), ["id"], F.col("v"), "s")
    assert all(r.s == r.id + 1 for r in run.collect())


def test_pca_and_minibatches():
    rng = np.random.default_rng(2)
    x, strata = rng.normal(size=(40, 6)), [i % 4 for i in range(40)]
    m = spectrum.fit_pca(x, strata, 0.9)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ unit / 40)
    top = axes[:, ::-1][:, : m["k"]]
    assert np.allclose(m["values"], values[::-1][: m["k"]]) and np.allclose(m["basis"] @ m["basis"].T, top @ top.T)
    assert spectrum.fit_pca(np.eye(4), [0, 0, 0, 0], 0.5)["k"] == 4  # ties are kept
    got = vectors.minibatch_directions(np.eye(2), np.array([5.0, 1.0]), np.array([[0, 0, 1, 1, 1]]), 5)
    assert np.allclose(got, np.array([[10, 3]]) / np.sqrt(109))


def test_packing(spark):
    limits = {"expected": 10, "most": 12, "longest": 8, "prefer": 5, "buffer": 2}
    rows = list(batching.Packer(**limits).run([("a", 7), ("b", 6), ("c", 9), ("d", 4), ("e", 5), ("f", 3), ("g", 8)]))
    assert rows == [(0, "a", 0, 7), (0, "d", 1, 4), (1, "b", 0, 6), (1, "e", 1, 5), (2, "f", 0, 3), (2, "g", 1, 8)]
    table = spark.createDataFrame([(w, i, n) for w in (0, 1) for i, n in enumerate([7, 6, 9, 4, 5, 3, 8])], "w int, i int, n int")
    got = batching.packed(table, "w", "i", "i", "n", **limits).collect()
    assert [(r.pack, r.tokens) for r in got if r.worker == 1] == [(p, n) for p, _, _, n in rows]


def test_judging(spark):
    table = spark.createDataFrame([("A", "p1", "x", "y"), ("what?", "p2", "x", "y"), ("who?", "p3", "x", "y")], "prediction string, prompt string, A string, B string")
    replies = {"p1": "B", "p2": "B.", "p3": "dunno"}
    run = lambda policy, judge: [(r.option, r.log) for r in judging.judged_options(table, "prediction", ["A", "B"], "prompt", judge, policy).collect()]

    def broken(_):
        raise RuntimeError

    assert run("exact_matching", replies.get) == [("A", ""), ("Z", ""), ("Z", "")]
    assert run("legacy", replies.get) == [("A", ""), ("B", ""), ("Z", judging.UNRESOLVED)]
    assert run("llm_first", replies.get) == [("B", ""), ("B", ""), ("Z", judging.UNRESOLVED)]
    assert [o for o, _ in run("llm_first", broken)] == ["A", "Z", "Z"]
    quiz = spark.createDataFrame([("A", "A", "x", "y", "s"), ("B", "A", "x", "y", "s")], "prediction string, answer string, A string, B string, split string")
    assert judging.evaluate(quiz).where("name = 'Overall'").first().accuracy == 0.5


def test_scores(spark):
    assert scores.tree_similarity(("a", [("b", []), ("c", [])]), ("a", [("b", []), ("d", [])])) == pytest.approx(2 / 3)
    assert scores.tree_similarity(("a", []), ("a", [])) == 1.0
    assert scores.located_counts([(0, 2)], [(1, 2)]) == pytest.approx(0.5**0.5) and scores.located_counts([], [(0, 1)]) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text('index,hit,question,answer,A,B\n001,1,"What\n  is it?",A,x,y\n1.0,0.0,q,B,x,\n')
    got = {r["index"]: r for r in readers.score_sheet(spark, str(tmp_path / "s.csv")).collect()}
    assert got["001"].question == "What is it?" and got["001"].hit == 1 and got["1"].options == {"A": "x"}
    rows = spark.createDataFrame([(1, "b"), (0, "a")], "ordinal long, uid string")
    meta = writers.manifest(rows, str(tmp_path / "m")).first()
    import hashlib

    assert (meta["count"], meta.ordered_uid_sha256) == (2, hashlib.sha256(b"a\nb\n").hexdigest())
    with pytest.raises(Exception):
        writers.manifest(rows, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="repeated"):
        writers.manifest(rows.union(rows), str(tmp_path / "n"))


def test_manifest_order_of_equal_ordinals(spark, tmp_path):
    import hashlib

    rows = spark.range(4000).select((F.col("id") % 7).alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("uid")).repartition(5)
    meta = writers.manifest(rows, str(tmp_path / "m")).first()
    got = readers.manifest(spark, str(tmp_path / "m/rows"), "uid string").orderBy("ordinal").collect()
    assert hashlib.sha256("".join(f"{r.uid}\n" for r in got).encode()).hexdigest() == meta.ordered_uid_sha256


def test_receipt_stream(spark, tmp_path):
    from gaugeframe.streaming import receipts

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1, "running"), ("b", 5, "done")], [("a", 3, "done"), ("b", 2, "running")]):
        spark.createDataFrame(part, "job string, at int, status string").coalesce(1).write.mode("append").json(source)
        receipts.status_stream(spark.readStream.schema("job string, at int, status string").json(source), out, str(tmp_path / "cp"), ["job"], F.col("at")).awaitTermination()
    assert {r.job: r.status for r in receipts.current(spark, out).collect()} == {"a": "done", "b": "done"}
