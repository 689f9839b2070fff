"""The stages of the pipeline on a small table with repeated rows, ids that are null or occur twice, and odd texts."""

import random

import pytest

import corpus_pipeline as P
from gaugeframe.llm import decontaminate, gam, langid, simhash

WORDS = {"en": "the and of with that this from for", "de": "der die und nicht das mit ein auf", "fr": "le les des une dans est pour qui"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, quality_score double"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(23)
    make = lambda lang, n=60: " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "a", "en", "s"]) + str(rng.randrange(3)) * rng.randrange(2) for _ in range(n)) + "."
    rows = []
    for i in range(240):
        lang = sorted(WORDS)[i % 3]
        text = make(lang) if i % 10 else " ".join(w + "###" for w in make(lang).split())
        rows.append((i, text, lang, f"s{i % 4}", len(text), 1, 0.5))
    passage = make("en", 30)
    rows += [(300, rows[1][1], "en", "s0", 0, 1, 0.5), (301, rows[1][1], "en", None, 0, 1, 0.5), rows[2], (2, rows[2][1], "fr", "other", 0, 1, 0.5), (3, make("de"), "de", "s1", 0, 1, 0.5)]
    rows += [(None, make("en"), "en", "s0", 0, 1, 0.5), (None, rows[4][1], None, "s0", 0, 1, 0.5), (302, None, None, None, None, None, None), (303, "", "en", "s0", 0, 1, 0.5), (304, "123 456", "en", "s0", 0, 1, 0.5)]
    rows += [(310 + i, f"{make('en', 20)} {passage} {make('en', 20)}", "en", "s2", 0, 1, 0.5) for i in range(3)]
    rows += [(None, rows[-4][1], "en", "s0", 0, 1, 0.5)] * 2
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return spark.read.parquet(f"{d}/documents.parquet"), d


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())


def test_filters(spark, corpus):
    docs, d = corpus
    kept = P.identify_language(spark, docs, d)
    judged = langid.predict(docs, langid.train(docs), P.AMBIGUOUS).where("language.lang_pred <> 'und' AND NOT language.ambiguous")
    assert kept.columns == docs.columns and ids(kept) == ids(judged) and not {302, 303, 304} & {i for i, _ in ids(kept)}
    good = P.classify_quality(spark, docs, d)
    model = gam.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert good.columns == docs.columns and ids(good) == ids(gam.score(docs.drop("quality_score"), model).where(f"quality_score >= {P.QUALITY}"))


def test_one_of_each_group_stays(spark, corpus):
    docs, d = corpus
    kept = P.drop_near_duplicates(spark, docs, d)
    assert kept.columns == docs.columns
    rows = kept.select("doc_id", "text").collect()
    named = [r.doc_id for r in rows if r.doc_id is not None]
    assert {1, 2, 3, 4} <= set(named) and not {300, 301} & set(named)
    assert len([r for r in rows if r.doc_id == 3]) == 2 and len([r for r in rows if r.doc_id == 2]) == 1  # two texts of one id, one text twice
    assert len(rows) == len({r.root for r in simhash.near_duplicates(docs).collect()})
    assert P.drop_near_duplicates(spark, docs.limit(0), d).count() == 0


def test_leaks_go(spark, corpus):
    docs, d = corpus
    kept = P.drop_benchmark_leaks(spark, docs, d)
    leaks = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert {310, 311, 312} <= leaks and kept.columns == docs.columns
    assert ids(kept) == [x for x in ids(docs) if (None if x[0] == -1 else x[0]) not in leaks]


def test_run(spark, corpus):
    docs, d = corpus
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, d))
    got = P.run(spark, d)
    assert sorted(map(tuple, got.select("doc_id", "size", "taken").collect()), key=str) == sorted(map(tuple, docs.select("doc_id", "size", "taken").collect()), key=str)
    for s in {r.source for r in got.collect()}:
        own = [r for r in got.collect() if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_each_group_keeps_a_row(spark, corpus):
    _, d = corpus
    rng = random.Random(29)
    a, b, c, e, f, g = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6))
    near = lambda t, n: " ".join([*t.split() * 12, f"x{n}"])
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, e), (9, e), (None, c), (None, b), (None, f), (None, f), (6, g), (6, g), (11, g)]
    rows += [(None, near(g, n)) for n in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0, 1, 0.5) for i, t in rows], SCHEMA)
    found = simhash.near_duplicates(docs).collect()
    at = {(r.doc_id, r.fp): r.root for r in found}
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, d).collect()]
    assert sorted(at[i, simhash.fingerprint(t.encode()) or 0] for i, t in got) == sorted(set(at.values()))
    assert {(3, a), (5, b), (6, g)} <= set(got) and [i for i, t in got if t == f] == [None]
    assert [i for i, t in got if t == c] == [8] and [i for i, t in got if t == e] == [8]
    bare = {r.root for r in found if r.doc_id is None and r.component_id is None}
    assert len(bare) < len({r.fp for r in found if r.root in bare})


def test_unrelated_texts_of_one_id_all_stay(spark, corpus):
    _, d = corpus
    rng = random.Random(31)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(3, a), (3, b), (4, b), (3, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0, 1, 0.5) for i, t in rows], SCHEMA)
    assert ids(P.drop_near_duplicates(spark, docs, d)) == sorted([(3, a), (3, b), (3, c)])
    rows = [(1, a), (1, b), (2, f"{a} more")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0, 1, 0.5) for i, t in rows], SCHEMA)
    assert {(1, b)} < set(ids(P.drop_near_duplicates(spark, docs, d))) <= set(rows)


def test_only_rows_that_leak_go(spark, corpus):
    _, d = corpus
    passage = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id = 0").first().text
    leak, clean = f"one two {passage} three", [f"a clean text number {i}" for i in range(4)]
    rows = [(None, leak), (None, clean[0]), (None, None), (7, leak), (7, clean[1]), (7, None), (8, clean[2]), (None, clean[3])]
    docs = spark.createDataFrame([(i, t, "en", "s0", 0, 1, 0.5) for i, t in rows], SCHEMA)
    want = sorted((-1 if i is None else i, t or "") for i, t in rows if t != leak)
    assert ids(P.drop_benchmark_leaks(spark, docs, d)) == want
