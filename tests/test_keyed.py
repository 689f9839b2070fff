"""Folds of components, keyed state in streams, filtered semi joins and archives, on small tables."""

import contextlib
import io
import tarfile
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeframe.operators import bloom, dependencies, folds, overlaps, quantiles, variants
from gaugeframe.sources import archives
from gaugeframe.streaming import states

ROWS = [("a", "s1", ["x"]), ("b", "s2", ["x", "y"]), ("b", "s3", ["y"]), ("a", "s4", None), ("a", "s4", []), ("a", None, ["z"]), (None, "s5", ["q"]), ("c", "s6", ["q", None])]


def folded(spark, rows=ROWS, pool=None, locked=()):
    df = spark.createDataFrame([(t, s, i, dict(locked).get(s)) for t, s, i in rows], "task string, src string, images array<string>, held int")
    pool = pool and spark.createDataFrame(pool, "identity string, fold int")
    got = folds.component_folds(df, "task", "src", F.col("images"), 5, 3, locked="held", pool=pool)
    assert got.columns == ["task", "src", "images", "held", "component", "fold"]
    return {r.src: (r.component, r.fold) for r in got.collect()}


def test_components_share_a_fold(spark):
    got = folded(spark)
    assert got["s1"] == got["s2"] == got["s3"] and got["s5"] == got["s6"] and len({c for c, _ in got.values()}) == 4
    assert got["s1"][0] == "image:x" and got["s4"][0] == "source:s4"
    # Ranks are within the least task: a holds three components, the one without a task comes first.
    assert sorted(f for c, f in set(got.values()) if c != "image:q") == [0, 1, 2] and got["s5"][1] == 0


def test_locks_reach_a_component(spark):
    assert folded(spark, locked=[("s3", 4)])["s1"][1] == 4
    got = folded(spark, pool=[("image:y", 3), ("image:x", 3), ("source:s4", 2), ("image:unknown", 1), (None, 1), ("image:q", None)])
    assert got["s1"][1] == got["s3"][1] == 3 and got["s4"][1] == 2 and got["s5"][1] == 0
    for conflict in ({"locked": [("s1", 0), ("s3", 1)]}, {"locked": [("s1", 0)], "pool": [("image:y", 2)]}, {"pool": [("source:s2", 1), ("image:y", 2)]}):
        with pytest.raises(ValueError, match="locked folds"):
            folded(spark, **conflict)
    assert folded(spark, rows=[]) == {}


def test_a_locked_component_takes_a_rank(spark):
    rows = [("t", f"s{i}", None) for i in range(40)]
    free, held = folded(spark, rows), folded(spark, rows, locked=[("s7", 4)])
    assert held["s7"][1] == 4 and all(held[s] == free[s] for s in free if s != "s7")


RECEIPT = "job string, at long, status string, note string"


def up_to_date(spark, where, rows):
    spark.createDataFrame(rows, RECEIPT).coalesce(1).write.mode("append").parquet(f"{where}/in")
    states.streamed(spark, f"{where}/in", spark.createDataFrame([], RECEIPT).schema, ["job"], ["at"], "status", f"{where}/out", f"{where}/check")
    return now(spark, where)


def now(spark, where):
    return {r.job: (r.at, r.status, r.note, r.stalled) for r in states.current(spark, f"{where}/out", ["job"], ["at"]).collect()}


def test_state_goes_on_from_the_checkpoint(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = up_to_date(spark, tmp_path, [("a", 1, "running", "x"), ("a", 3, "done", None), ("b", 5, "running", "y"), (None, 2, "failed", "z"), ("c", None, "running", "w")])
    assert first == {"a": (3, "done", None, False), "b": (5, "running", "y", False), None: (2, "failed", "z", False), "c": (None, "running", "w", False)}
    second = up_to_date(spark, tmp_path, [("a", 2, "failed", "late"), ("b", 6, "failed", "oom"), ("d", 1, "running", "new"), ("c", None, "done", "tie")])
    assert second == {**first, "b": (6, "failed", "oom", False), "d": (1, "running", "new", False)}
    # The second run wrote the two keys that changed, not the table.
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 2
    assert before == spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_runs_that_stall(spark, tmp_path):
    spark.createDataFrame([("a", 1, "running", "x"), ("c", 1, "done", "z")], RECEIPT).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = states.session(spark).readStream.schema(RECEIPT).parquet(f"{tmp_path}/in")
    stream = states.store_changes(states.latest_changes(rows, ["job"], ["at"], "status", stall=100), f"{tmp_path}/out", f"{tmp_path}/check", every="1 second")

    def wait(job, want):
        end = time.time() + 60
        while time.time() < end:
            with contextlib.suppress(AnalysisException):  # nothing is written yet
                if now(spark, tmp_path).get(job) == want:
                    return True
            time.sleep(0.5)
        return False

    try:
        assert wait("a", (1, "running", None, True)) and now(spark, tmp_path)["c"] == (1, "done", "z", False)
        spark.createDataFrame([("a", 4, "done", "late")], RECEIPT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert wait("a", (4, "done", "late", False))
    finally:
        stream.stop()


@pytest.mark.parametrize("bits", [None, 64 * bloom.ROW])
def test_filtered_joins(spark, bits):
    left = spark.createDataFrame([(i % 700 if i % 50 else None, str(i % 3), i) for i in range(3000)], "a long, b string, _filter_ int")
    right = spark.createDataFrame([(i, str(i % 2), 0) for i in range(0, 900, 3)] + [(None, "1", 0), (3, "1", 1)], "a int, b string, x int")
    for key in (["a"], ["a", "b"]):
        keys = right.select(*key).withColumn("a", F.col("a").cast("long"))
        for found, how in ((bloom.filtered_semi(left, right, key, bits), "left_semi"), (bloom.filtered_anti(left, right, key, bits), "left_anti")):
            assert found.columns == left.columns
            assert sorted(map(str, found.collect())) == sorted(map(str, left.join(keys, key, how).select(left.columns).collect()))
    assert bloom.filtered_anti(left, right.limit(0), ["a"]).count() == 3000 and bloom.filtered_semi(left, right.limit(0), ["a"]).count() == 0
    assert bloom.filtered_anti(left.limit(0), right, ["a"]).count() == 0


def test_few_rows_pass_a_filter_by_mistake(spark):
    keys, others = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(100_000, 200_000).withColumnRenamed("id", "k")
    hit, miss, _ = bloom._parts(others.unionByName(keys), keys, ["k"], None)
    assert hit.count() + miss.count() == 120_000 and keys.join(hit, "k", "left_anti").isEmpty() and hit.count() < 20_000 + 1000
    plan = miss._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_exact_quantiles(spark, q):
    rng = np.random.default_rng(5)
    groups = {"even": rng.random(5000), "ties": np.repeat([1.0, 2.0], 2500), "skew": rng.lognormal(0, 8, 5001), "one": np.array([7.0]), "same": np.full(3000, -1.5), None: -rng.random(999)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for small in (50, quantiles.SMALL):
        got = {r.g: r.v for r in quantiles.exact_quantile(df, "x", q, ["g"], "v", small=small).collect()}
        assert got.pop("none") is None and got == pytest.approx({k: np.quantile(v, q) for k, v in groups.items()}, rel=1e-12)
    assert quantiles.exact_quantile(df.limit(0), "x", q, ["g"], "v").count() == 0


def tar(files, kind="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=kind) as t:
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


FILES = [("a", b"x" * 700), ("b", b""), ("c" * 120, b"long name"), ("d", b"y" * 512), ("a", b"again")]


@pytest.mark.parametrize("kind", ["w", "w:gz"])
def test_members_of_whole_archives(spark, kind):
    rows = [("one", tar(FILES, kind)), ("none", tar([], kind)), ("empty", b""), ("null", None)]
    archive = spark.createDataFrame(rows, "path string, content binary")
    wanted = spark.createDataFrame([("a",), ("c" * 120,), ("zzz",), (None,), ("a",)], "name string")
    for most in (archives.MOST_WANTED, 1):
        archives.MOST_WANTED, before = most, archives.MOST_WANTED
        try:
            got = archives.members_of(archive, wanted).collect()
        finally:
            archives.MOST_WANTED = before
        assert sorted((r.archive, r.name, bytes(r.content), r.gap) for r in got) == sorted(("one", n, c, None) for n, c in FILES if n in ("a", "c" * 120))


def test_damage_is_a_row_and_later_members_are_read():
    whole = tar(FILES)
    names = lambda data: [n or "gap" for n, _, _ in archives.members(data, None)]
    assert names(whole) == [n for n, _ in FILES]
    broken = bytearray(whole)
    broken[1536 + 20] ^= 255  # the header of b
    assert names(bytes(broken)) == ["a", "gap", "c" * 120, "d", "a"]
    assert names(bytes(broken[:1536] + b"junk" * 300 + broken[1536 + 1200 :]))[:2] == ["a", "gap"]
    for cut in (600, 1100):  # within the first member
        assert names(whole[:cut]) == ["gap"]
    packed = tar(FILES, "w:gz")
    assert names(packed[: len(packed) // 2])[-1] == "gap" and names(packed[:-1] + b"\0")[-1] in ("a", "gap")
    assert names(b"not an archive" * 100)[-1] == "gap" and names(b"\0" * 10240) == []


def test_paths_of_any_shape(spark):
    texts = {1: '{"a": {"b": [1, {"c": null}], "d": {}}, "e": "x"}', 2: "[]", 3: "7", 4: None, 5: "{broken", 6: '{"": true, "n": [[2.5]]}'}
    got = variants.json_paths(spark.createDataFrame(list(texts.items()), "id int, doc string"), "doc", ["id"]).collect()
    want = {(1, ".a.b[0]", "1"), (1, ".a.b[1].c", None), (1, ".a.d", "{}"), (1, ".e", "x"), (2, "", "[]"), (3, "", "7"), (6, ".", "true"), (6, ".n[0][0]", "2.5")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_paths_are_laid_over_each_other(spark):
    kind = "id int, path string, value string"
    base = spark.createDataFrame([(1, ".a", "1"), (1, ".b.c", "2"), (1, ".b.d", "3"), (1, ".e.f[0]", "4"), (2, ".a", "5"), (None, ".a", "6")], kind)
    over = spark.createDataFrame([(1, ".a.x", "7"), (1, ".b.c", "8"), (1, ".e", "9"), (3, ".n", "0"), (None, ".a", "n")], kind)
    got = {tuple(r) for r in variants.merged_paths(base, over, ["id"]).collect()}
    assert got == {(1, ".a.x", "7"), (1, ".b.c", "8"), (1, ".b.d", "3"), (1, ".e", "9"), (2, ".a", "5"), (3, ".n", "0"), (None, ".a", "n")}


def test_laid_paths_are_not_broadcast(spark):
    """Not even where the files are small: compressed, they say little about the table."""
    kind = "id int, path string, value string"
    df = variants.merged_paths(spark.createDataFrame([(1, ".a", "1")], kind), spark.createDataFrame([(1, ".a.x", "7")], kind), ["id"])
    assert [tuple(r) for r in df.collect()] == [(1, ".a.x", "7")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2


def test_overlaps_by_brute_force(spark):
    rng = np.random.default_rng(11)
    sides = []
    for n in (150, 120):
        start = rng.integers(-2000, 2000, n).astype(float).tolist()
        sides.append([(None if i % 9 == 0 else int(i % 3), i, s, s + float(2.0 ** rng.integers(-2, 11)) * (i % 17 > 0)) for i, s in enumerate(start)])
        sides[-1] += [(0, n, None, 1.0), (0, n + 1, 5.0, None), sides[-1][5]]
    left, right = (spark.createDataFrame(s, "g int, id int, start double, end double") for s in sides)
    shared = lambda a, b: None in a[2:] + b[2:] and -1 or min(a[3], b[3]) - max(a[2], b[2])
    want = sorted((str(a[0]), a[1], b[1], shared(a, b)) for a in sides[0] for b in sides[1] if a[0] == b[0] and shared(a, b) > 0)
    got = overlaps.overlapping(left, right, ["g"]).select("g", "left.id", F.col("right.id").alias("other"), "overlap").collect()
    assert sorted((str(r.g), r.id, r.other, r.overlap) for r in got) == want and len(want) > 300
    size = lambda x: x[3] - x[2]
    best = {}
    for a in sides[0]:
        options = [(-shared(a, b) / (size(a) + size(b) - shared(a, b)), b[1]) for b in sides[1] if a[0] == b[0] and shared(a, b) > 0]
        best[a[1]] = (min(options)[1], -min(options)[0]) if options else (None, 0.0)
    for r in overlaps.nearest(left, right, ["g"], "id").collect():
        assert (r.match, r.iou) == (best[r.id][0], pytest.approx(best[r.id][1]))
    assert overlaps.overlapping(left.limit(0), right.limit(0), ["g"]).count() == 0


def test_chains_of_jobs(spark):
    kind = "job long, up long"
    chain = [(i, i - 1 if i % 100 else None) for i in range(300)]
    got = {r.job: (r.ancestors, r.root) for r in dependencies.ancestors(spark.createDataFrame(chain, kind), "job", "up").collect()}
    assert got == {i: (i % 100, i - i % 100) for i in range(300)}
    assert dependencies.ancestors(spark.createDataFrame([], kind), "job", "up").count() == 0
    for rows, what in (([(1, 2), (2, 3), (3, 1), (4, None)], "ring"), ([(1, 1)], "ring"), ([(1, 9)], "missing"), ([(1, None), (1, None)], "repeated")):
        with pytest.raises(ValueError, match=what):
            dependencies.ancestors(spark.createDataFrame(rows, kind), "job", "up")
