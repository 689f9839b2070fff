"""Guards, brute-force checks of what SQL can't say, and work that must not meet in one task."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions import hashing, pytext
from gaugeframe.operators import joins, reshape, sampling, scores, spectrum, tables, transfer, vectors
from gaugeframe.plans import vectors as vector_plans
from gaugeframe.sources import archives, readers, writers


def facts(spark, rows):
    return spark.createDataFrame([(q, "B", "F", "C", m, s, h) for q, m, s, h in rows], "uid string, benchmark string, family string, capability string, model string, seed int, hit int")


def full(seeds, questions=("a", "b"), models=("base", "m")):
    return [(q, m, s, (hash((q, m, s)) >> 3) & 1) for q in questions for m in models for s in seeds]


def test_paired_runs_are_checked(spark):
    assert transfer.difference_counts(facts(spark, full([1, 2, 3])), "base").count() > 0
    for rows, what in [
        (full([1, 2, 3, 4]), "1 to 3"),
        (full([1, 2]) + [("a", "m", 3, 1)], "has the seeds"),
        (full([1], models=("m",)), "no run"),
        (full([-1]), "not negative"),
    ]:
        with pytest.raises(ValueError, match=what):
            transfer.difference_counts(facts(spark, rows), "base")
    for rows in (full([1, 2])[:-1] + [("c", m, s, 1) for m in ("base", "m") for s in (1, 2)], full([1]) + full([1])[:1], full([1]) + [("c", "m", 1, 1)]):
        with pytest.raises(Exception, match="missing or repeated"):
            transfer.difference_counts(facts(spark, rows), "base").collect()
    with pytest.raises(Exception, match="no run with seed"):
        transfer.per_seed(facts(spark, [("a", "base", 1, 1), ("a", "m", 1, 1), ("a", "m", 2, 1)]), "base").collect()


def test_contractions():
    assert len(pytext.CONTRACTIONS) == 120
    for said, want in {"itll": "it'll", "yall": "y'all", "shant": "shan't", "oclock": "o'clock", "youd've": "you'd've", "id": "id", "whore": "whore", "wed": "wed", "lets": "lets", "im": "im"}.items():
        assert pytext.plain_answer(said) == want


def test_numerical_answers(spark):
    from gaugeframe.functions import finals

    said = {
        "x\n#### 18": 18, "Final answer: $1/4": 0.25, "The answer is 3.5.\nthe ANSWER IS 2": 2, "the answer is -2": 2, "Thus we get = 7": 7, "a\n$ 1,200": 1200, "so\n\n2 + 3 = 5 things\nand more": 5, "none": None, "5/0": 0, "it costs 3 and 4": 3,
        "He makes $1,250 today.": 1250, "It costs $3,400 in all": 3400, "a total of 2,500 apples": 2500, "so \\boxed\\{42\\}, then 7 more": 42, "a\n$3/4": 0.75, "": None, None: None, " \n\u3000 12 \n": 12, "12 dollars\n\n": 12, "1.5/2": 2,
    }
    rows = spark.createDataFrame([(k,) for k in said], "said string").withColumn("n", finals.numerical_answer(F.col("said"))).collect()
    assert {r.said: r.n for r in rows} == said


def test_orders(spark):
    from gaugeframe.functions import finals

    said = {"so BDAC it is": "BDAC", "first C, second A, third B, fourth D": "CABD", "AABC": None, "": None, None: None, "首先 B 其次 A 再次 D 最后 C": "BADC", "STEP 1: a. step 2 c, 步骤三 B 第四步 D": "ACBD", "案BDAC": None, "first A second A third B fourth C": None}
    rows = spark.createDataFrame([(k,) for k in said], "said string").withColumn("o", finals.option_order(F.col("said"))).collect()
    assert {r.said: r.o for r in rows} == said


def test_damerau_in_rows():
    assert [pytext.damerau(a, b) for a, b in (("ca", "abc"), ("", "ab"), ("abcd", "badc"), ("kitten", "sitting"), ("same", "same"), ("a cat", "an act"))] == [2, 2, 2, 3, 0, 2]
    assert pytext.damerau("ab" * 500, "ba" * 500) == 2


def test_digests_choices_and_merges(spark):
    assert pytext.canonical_json('{"b": 1, "a": {"d": "é", "c": [2, 1]}}') == '{"a":{"c":[2,1],"d":"é"},"b":1}'
    with pytest.raises(ValueError):
        pytext.canonical_json("[NaN]")
    assert pytext.merged_json('{"a": {"x": 1, "y": 2}, "b": 1}', '{"a": {"y": 3}, "b": {"z": 1}}') == '{"a":{"x":1,"y":3},"b":{"z":1}}'
    rows = spark.range(20).select("id", pytext.column(pytext.seeded_choice, "string", F.col("id"), F.array(*map(F.lit, "abcde"))).alias("c"))
    assert all(r.c == random.Random(r.id).choice(list("abcde")) for r in rows.collect())
    order = list(range(50))
    random.Random(9).shuffle(order)
    assert {r.place: r.id for r in readers.shuffled_take(spark.range(50), "id", 50, 7, 9).collect()} == dict(enumerate(order[:7]))


def test_gram_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "WIDTH", 3)
    x = np.random.default_rng(1).normal(size=(11, 8))
    rows = spark.createDataFrame([(f"k{i:02}", r.tolist()) for i, r in enumerate(x)], "k string, v array<double>")
    got = {(r.i, r.j): r.dot for r in vectors.gram(rows, "k", "v").collect()}
    assert len(got) == 66
    for i, j in itertools.combinations_with_replacement(range(11), 2):
        assert got[f"k{i:02}", f"k{j:02}"] == pytest.approx(x[i] @ x[j])
    with pytest.raises(ValueError, match="repeated"):
        vectors.gram(rows.union(rows), "k", "v")
    monkeypatch.setattr(vectors, "MOST_POOL", 10)
    with pytest.raises(ValueError, match="more than"):
        vectors.gram(rows, "k", "v")


def brute_basis(x, strata, energy):
    """The primal way: eigenvectors of the weighted second moment of unit rows."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names, n = np.unique(strata, return_counts=True)
    w = np.array([1 / (len(names) * n[names == s][0]) for s in strata])
    values, axes = np.linalg.eigh((unit * w[:, None]).T @ unit)
    values, axes = values[::-1], axes[:, ::-1]
    k = next(i + 1 for i in range(len(values)) if values[: i + 1].sum() >= energy * values.sum())
    p = unit @ axes[:, :k]
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    m = (p * w[:, None]).T @ p
    return k, values[:k].sum() / values.sum(), np.trace(m) ** 2 / (m**2).sum(), axes[:, :k], values[0]


def test_pca_by_fold_and_projection_by_brute_force(spark, sf):
    rows = vector_plans._rows(spark, sf)
    data = rows.collect()
    x = np.array([r.embedding for r in data], float)
    fits = {}
    for r in vector_plans.pca_energy_folds(spark, sf).collect():
        train = [i for i, d in enumerate(data) if d.fold != r.held_out]
        k, captured, d_eff, axes, first = fits[r.held_out] = brute_basis(x[train], np.array([f"{data[i].label}|{data[i].objective}" for i in train]), 0.99)
        assert (r.k, r.rows) == (k, len(train)) and (r.captured, r.d_eff, r.first_value) == pytest.approx((captured, d_eff, first))
    place = {d.vec_id: i for i, d in enumerate(data)}
    pairs = spectrum.projected_pairs(rows.withColumn("fold", F.floor(F.col("vec_id") / 2) % 5).withColumn("pair", F.floor(F.col("vec_id") / 2)), "embedding", "fold", ["label", "objective"], 5, "pair", "objective")
    got = pairs.collect()
    assert len(got) == len(data) // 2
    for f in range(5):
        train = [i for i, d in enumerate(data) if d.vec_id // 2 % 5 != f]
        _, _, d_eff, axes, _ = brute_basis(x[train], np.array([f"{data[i].label}|{data[i].objective}" for i in train]), 0.99)
        for r in (r for r in got if r.fold == f):
            a, b = (x[place[2 * r.pair + s]] for s in (0, 1))
            p, q = a @ axes, b @ axes
            cosine = p @ q / np.linalg.norm(p) / np.linalg.norm(q)
            assert (r.cosine, r.normalised, r.raw) == pytest.approx((cosine, cosine * d_eff**0.5, a @ b / np.linalg.norm(a) / np.linalg.norm(b)))


def test_minibatch_alignment_by_brute_force(spark, sf):
    rows = vector_plans._rows(spark, sf).withColumn("task", F.col("label") % 2).withColumn("tokens", F.col("vec_id") % 17 + 1)
    got = {(r.source, r.target): r for r in vectors.minibatch_alignment(rows, "embedding", "task", "objective", "fold", "tokens", "vec_id", repeats=20, batch=4).collect()}
    data = sorted(rows.collect(), key=lambda r: str(r.vec_id))
    mean, half, weight = {}, {}, {}
    for f in range(5):
        unit = {}
        for t, s in itertools.product("01", ("i2i", "i2t")):
            own = [r for r in data if (str(r.task), r.objective, r.fold) == (t, s, f)]
            picks = vectors.draws(7, f"point:{t}:{s}:fold:{f}", len(own), 20)[:, :4]
            sums = np.array([sum(np.array(own[i].embedding, float) * own[i].tokens for i in p) for p in picks])
            unit[t, s] = sums / np.linalg.norm(sums, axis=1, keepdims=True), len(own)
        for a, b in itertools.product("01", repeat=2):
            c, n = (unit[a, "i2i"][0] * unit[b, "i2t"][0]).sum(1), unit[b, "i2t"][1]
            for acc, v in ((mean, c.mean() * n), (half, c[:10].mean() * n), (weight, n)):
                acc[a, b] = acc.get((a, b), 0) + v
    for k, r in got.items():
        assert r.alignment == pytest.approx(mean[k] / weight[k]) and r.prefix_difference == pytest.approx((mean[k] - half[k]) / weight[k])


def test_minibatch_alignment_of_a_large_pool(spark):
    n = 2 * vectors.MOST_POOL + 2
    rows = spark.range(n).select(F.col("id").alias("key"), F.lit("t").alias("task"), F.when(F.col("id") % 2 == 0, "i2i").otherwise("i2t").alias("side"), F.lit(0).alias("fold"), (F.col("id") % 5 + 1).alias("tokens"), F.array(F.sin("id"), F.lit(1.0)).alias("x"))
    (got,) = vectors.minibatch_alignment(rows, "x", "task", "side", "fold", "tokens", "key", repeats=6, batch=3).collect()
    unit = {}
    for s, side in enumerate(("i2i", "i2t")):
        ids = np.array(sorted(range(s, n, 2), key=str))[vectors.draws(7, f"point:t:{side}:fold:0", n // 2, 6)[:, :3]]
        sums = (np.stack([np.sin(ids), np.ones(ids.shape)], 2) * (ids % 5 + 1)[:, :, None]).sum(1)
        unit[side] = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    c = (unit["i2i"] * unit["i2t"]).sum(1)
    assert got.n == n // 2 and (got.alignment, got.mcse, got.prefix_difference) == pytest.approx((c.mean(), (c.var(ddof=1) / 6) ** 0.5, c.mean() - c[:3].mean()))
    with pytest.raises(Exception, match="positive"):
        vectors.minibatch_alignment(rows.withColumn("tokens", F.lit(0)), "x", "task", "side", "fold", "tokens", "key").collect()


def test_ranks_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(40), i) for i in range(900)]
    table = spark.createDataFrame(rows, "g string, v int, i int")
    seen, want = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert {r.i: r.repeat_index for r in sampling.occurrence(table, ["g"], ["v", "i"]).collect()} == want
    for r in sampling.average_rank(table.where("g = 'hot'"), "v", "rank").collect():
        hot = [v for g, v, _ in rows if g == "hot"]
        assert r["rank"] == sum(x < r.v for x in hot) + (hot.count(r.v) - 1) / 2
    spans = spark.createDataFrame([("k", s, s + rng.randrange(30)) for s in (rng.randrange(5000) for _ in range(300))], "k string, s int, e int")
    bare = spans.union(spans.selectExpr("NULL", "s", "e"))
    assert sorted((r.s, r.e, r.merged) for r in reshape.merge_intervals(bare, ["k"], "s", "e").where("k IS NULL").collect()) == sorted((r.s, r.e, r.merged) for r in reshape.merge_intervals(spans, ["k"], "s", "e").collect())
    merged, flat = [], sorted((r.s, r.e) for r in spans.collect())
    for s, e in flat:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    assert sorted([r.s, r.e] for r in reshape.merge_intervals(spans, ["k"], "s", "e").collect()) == merged


def test_draws_don_t_depend_on_the_partitions(spark):
    table = spark.range(300).select("id", (F.col("id") % 7).alias("s"), (F.col("id") % 5).alias("t"), (F.col("id") % 3).alias("c"))
    for one in (lambda d: scores.bootstrap_ci(d, "s", "c", draws=30, key="id"), lambda d: scores.permutation_p(d, "s", "t", draws=30)):
        assert one(table).collect() == one(table.repartition(7)).collect()


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0.5, 3), ("b", 1, 0.25, 1)], "uid string, fold int, loss double, loss_tokens int")
    values = spark.createDataFrame([(u, n, [1.0, 2.0]) for u in "ab" for n in ("p", "q")], "uid string, name string, values array<double>")
    writers.artifact(rows, values, str(tmp_path / "ok"))
    assert readers.artifact(spark, str(tmp_path / "ok")).count() == 4
    bad = [(rows, values.where("uid <> 'b' OR name <> 'q'")), (rows, values.withColumn("values", F.array(F.lit(float("nan")), F.lit(1.0)))), (rows.withColumn("loss_tokens", F.lit(0)), values)]
    for i, (r, v) in enumerate(bad):
        writers.artifact(r, v, str(tmp_path / f"bad{i}"))
        with pytest.raises(ValueError):
            readers.artifact(spark, str(tmp_path / f"bad{i}"))


def test_pins_and_selections(spark, tmp_path):
    (tmp_path / "s.csv").write_text("index,hit,question,answer\n1,1,q,a\n")
    digest = readers.file_digests(spark, str(tmp_path / "s.csv")).first().sha256
    assert readers.score_sheet(spark, str(tmp_path / "s.csv"), sha256=digest).count() == 1
    with pytest.raises(ValueError, match="pinned"):
        readers.score_sheet(spark, str(tmp_path / "s.csv"), sha256="0" * 64)
    spark.range(5).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="digests"):
        readers.shards(spark, [str(tmp_path / "t")], sha256={"x": "y"})
    with pytest.raises(ValueError, match="bad id"):
        readers.frozen(spark.createDataFrame([("p 1",)], "id string"), "id", r"p_\d+", 1)
    with pytest.raises(ValueError, match="missing"):
        readers.selected(spark.createDataFrame([('{"a": 1}',)], "r string"), "r", spark.createDataFrame([("0",)], "digest string"))
    with pytest.raises(ValueError, match="no writer"):
        writers.dump(spark.range(1), str(tmp_path / "x.pkl"))


def test_table_digest(spark):
    import hashlib

    rows = spark.range(1000).select((-F.col("id")).alias("o"), F.concat(F.lit("u"), "id").alias("uid")).repartition(5)
    want = hashlib.sha256("".join(f"u{i}\n" for i in reversed(range(1000))).encode()).hexdigest()
    assert tuple(hashing.table_digest(rows, "o", "uid").first()) == (1000, want)


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.scratch(Elsewhere)
    assert tables.scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_broadcasts_are_checked(spark, monkeypatch):
    monkeypatch.setattr(reshape, "MOST_VALUES", 3)
    monkeypatch.setattr(joins, "MOST_VALUES", 3)
    pairs = spark.range(9).select((F.col("id") % 2).alias("a"), "id")
    with pytest.raises(ValueError):
        reshape.missing_grid(pairs, "a", "id")
    with pytest.raises(ValueError):
        joins.grid_difference(pairs, pairs.select("a"), pairs.select("id"))


def test_denotations_and_puzzles():
    from gaugeframe.functions import denotation as D

    assert D.same_denotation(["3", "May [1]"], ["3.0", "“may”"]) and not D.same_denotation(["3"], ["3", "4"])
    assert D.same_denotation(["2001-05-xx"], ["2001-5-xx"]) and D.value("2001-xx-xx") == ("number", 2001.0) and D.value("x-1-2")[0] == "text"
    assert D.unescaped("a\\pb|c\\n\\\\") == ["a|b", "c\n\\"]
    assert D.same_amount("1,500", "$1.5 thousand") and D.same_amount("5%", "0.05") and not D.same_amount("5", "6 million")
    assert D.grid("1 . \n. 2") == [[1, 0], [0, 2]] and D.grid("x") is None and not D.sudoku("[[1]]", "[[1]]")
    assert D.makes([1, 5, 5, 5], "5 * (5 - 1 / 5) = 24") and not D.makes([1, 5, 5, 5], "5 * 5 - 1") and not D.makes([1], "__import__('os')")
    assert D.solvable([1, 5, 5, 5]) and not D.solvable([1, 1, 1, 1])
    assert D.word_ladder("cold", "warm", ["cold", "cord", "word", "ward", "warm"]) and not D.word_ladder("a", "b", [])


def test_archives(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    for i in range(3):
        with tarfile.open(tmp_path / f"{i}.tar.gz", "w:gz") as tar:
            for j in range(4):
                info = tarfile.TarInfo(f"{i}/{j}.txt")
                info.size = 3
                tar.addfile(info, io.BytesIO(f"{i}-{j}".encode()))
    (tmp_path / "9.tar").write_bytes(b"nothing")
    wanted = spark.createDataFrame([("0/1.txt",), ("2/3.txt",), ("none",)], "name string")
    assert sorted((r.name, bytes(r.content)) for r in archives.tar_members(spark, str(tmp_path), wanted).where("gap IS NULL").collect()) == [("0/1.txt", b"0-1"), ("2/3.txt", b"2-3")]
    with pytest.raises(ValueError, match="digest"):
        readers.verified(spark, str(tmp_path / "9.tar"), "0")
    assert readers.verified(spark, str(tmp_path / "9.tar"), hashlib.md5(b"nothing").hexdigest())


def test_stretched_pixels(spark):
    from gaugeframe.functions import numeric

    rng = np.random.default_rng(4)
    for n in (1, 5, 40):
        x = np.append(rng.integers(0, 5000, n), [65535] * 3).astype(float)
        got = spark.range(1).select(numeric.stretched(F.array(*map(F.lit, x.tolist())), 0.02, 0.98, 65535.0).alias("p")).first().p
        valid = x[x < 65535] if n >= 16 else x
        lo, hi = np.percentile(valid, 2), np.percentile(valid, 98)
        assert got == (np.clip((x - lo) / ((hi if hi > lo else lo + 1) - lo), 0, 1) * 255).astype(np.uint8).tolist()


def test_command_line(spark, tmp_path):
    from gaugeframe.__main__ import parser, run

    at = lambda name: str(tmp_path / name)
    do = lambda *args: run(spark, parser().parse_args([*map(str, args)]))
    (tmp_path / "q.csv").write_text("index,A,B,answer,prediction,hit,split\n1,x,y,A,A,1,s\n2,x,y,B,Failed to obtain answer via API,0,s\n")
    (tmp_path / "m.csv").write_text("model\nm\nn\n")
    (tmp_path / "d.csv").write_text("dataset\nd\ne\n")
    (tmp_path / "r.csv").write_text("model,dataset\nm,d\nn,d\nn,e\n")
    assert do("circular", at("q.csv"), at("c.jsonl"), "--options", "AB").count() == 4
    assert do("merge", at("q.csv"), at("m.csv"), at("u.parquet")).count() == 4
    assert [tuple(r) for r in do("missing", at("r.csv"), at("m.csv"), at("d.csv"), at("g.csv")).collect()] == [("m", "e")]
    assert tuple(do("scan", at("q.csv")).first()) == (2, 1, 0.5)
    assert {r.name: r.accuracy for r in do("report", at("q.csv"), at("a.csv"), "--split", "split", "--by", "answer").collect()} == {"Overall": 0.5, "A": 1.0, "B": 0.0}
    assert do("convert", at("q.csv"), at("q.tsv")).count() == 2 and readers.load(spark, at("q.tsv")).count() == 2


def test_run_hashes(spark):
    rng = random.Random(6)
    words = [rng.choice("abcd") for _ in range(200)]
    for n, size in itertools.product((0, 1, 4, 5, 200), (1, 2, 5, 8)):
        got = spark.range(1).select(hashing.run_hashes(F.array(*map(F.lit, words[:n])) if n else F.array().cast("array<string>"), size).alias("h")).first().h
        runs = [tuple(words[i : i + size]) for i in range(n - size + 1)]
        assert len(got) == len(runs) and len({*zip(got, runs)}) == len(set(got)) == len(set(runs))


def test_documents(spark):
    from gaugeframe.functions import documents as O

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(O.squeezed(F.lit("a______b" + "-" * 12 + "     " + "z" * 12))) == "a____b----    " + "z" * 12
    assert one(O.unfenced(F.lit("```markdown\n# T\n```\n"))) == "# T\n" and one(O.half_width(F.lit("Ａ１！　ｚ"))) == "A1! z"
    assert one(O.plain_formula(F.lit(r"\[ \mathrm{A} \hspace{1em} + B. \] x"))) == "{a}+b" and one(O.bare(F.lit("a-b\tc/td é"))) == "abcdé"


def test_edits_with_transpositions_against_another_engine():
    import duckdb

    rng = random.Random(8)
    pairs = [("".join(rng.choices("abc", k=rng.randrange(9))), "".join(rng.choices("abc", k=rng.randrange(9)))) for _ in range(300)]
    con = duckdb.connect()
    for a, b in pairs:
        assert pytext.damerau(a, b) == con.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchone()[0], (a, b)


def test_sketches_are_linear_and_keep_products_in_the_mean(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=200), rng.normal(size=200) + 0.5
    vec = lambda v: F.array(*map(F.lit, v.tolist()))
    got = spark.range(1).select(*[vectors.count_sketch(vec(v), 32, 3).alias(n) for n, v in (("x", x), ("y", y), ("z", x + 2 * y))]).first()
    assert np.allclose(np.array(got.z), np.array(got.x) + 2 * np.array(got.y))
    seeds = spark.range(60).select("id").collect()
    dots = [np.dot(*[np.array(v) for v in spark.range(1).select(vectors.count_sketch(vec(x + 1), 32, 2 * s.id).alias("a"), vectors.count_sketch(vec(y + 1), 32, 2 * s.id).alias("b")).first()]) for s in seeds[:12]]
    true = float((x + 1) @ (y + 1))
    assert abs(np.mean(dots) - true) < 4 * np.linalg.norm(x + 1) * np.linalg.norm(y + 1) / np.sqrt(32 * len(dots))


def test_streams_keep_their_weights(spark):
    drawn = scores.weighted_draws(spark.range(20_000).select(F.col("id").alias("n")), "g", {"a": 1.0, "b": 3.0}, "n")
    n = {r.g: r["count"] for r in drawn.groupBy("g").count().collect()}
    assert abs(n["b"] / 20_000 - 0.75) < 0.02 and sum(n.values()) == 20_000


def test_resampling_agrees_with_theory(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(400)]
    table = spark.createDataFrame([(i, v, v - 0.02 * (i % 2)) for i, v in enumerate(values)], "id int, s double, t double")
    low, high = scores.bootstrap_ci(table, "s", draws=400, key="id").first()
    spread = 1.96 * np.std(values) / 20
    assert abs(low - (np.mean(values) - spread)) < 0.01 and abs(high - (np.mean(values) + spread)) < 0.01
    assert scores.permutation_p(table, "s", "s", draws=50).first().p == 1.0 and scores.permutation_p(table, "s", "t", draws=50).first().p == 0.0
