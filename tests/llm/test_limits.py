"""Sizes and damage at which an operator must neither fail nor slow down out of proportion."""

import gzip
import hashlib
import random
import time
import zlib

import pytest

from gaugeframe.llm import decontaminate, gam, toxicity, urlrules, warc


def record(text, kind="resource", http=None):
    block = (http or "").encode() + text.encode()
    more = "Content-Type: application/http\r\n" if http else ""
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{more}WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_a_bad_payload_length_is_a_gap():
    bad = record("", "revisit", "HTTP/1.1 200 OK\r\nContent-Length: abc\r\n\r\n")
    got = [x[2] and x[2]["payload"] for x in warc.salvage(record("one") + bad + record("two"))]
    assert got == [b"one", None, b"two"]


def test_members_inside_members():
    data = record("deep")
    for _ in range(3):
        data = gzip.compress(data)
    assert [x[2]["payload"] for x in warc.salvage(data)] == [b"deep"]
    for _ in range(1200):
        data = gzip.compress(data, 0)
    got = list(warc.salvage(data + record("after")))
    assert [x[2] is not None for x in got] == [False, True]


def timed(data):
    began = time.process_time()
    got = list(warc.salvage(data))
    return got, time.process_time() - began


def test_many_members_take_linear_time():
    rng = random.Random(1)
    part = [gzip.compress(record(f"{i} " + rng.randbytes(4000).hex())) for i in range(200)]
    few, short = timed(b"".join(part * 5))
    many, long = timed(b"".join(part * 50))
    assert (len(few), len(many)) == (1000, 10_000) and all(x[2] for x in many) and long < 25 * short + 2


def test_much_damage_takes_linear_time():
    spoiled = record("x" * 400).replace(b"x" * 9, b"y" * 9, 1)
    few, short = timed(spoiled * 10_000)
    many, long = timed(spoiled * 90_000 + record("end"))
    assert len(few) == 1 and [x[2] is not None for x in many] == [False, True] and len(spoiled) * 90_000 > 49_000_000
    assert long < 25 * short + 2


def test_files_close_by_bytes_and_ids_survive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    rows = [(f"a>b\r\n {i}%", "u", "x" * (300 if i % 3 else 90_000) + str(i // 2)) for i in range(120)] + [(None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert max(sizes) < 250_000 and len(sizes) > 20
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id or "", r.payload_digest) for r in got) == sorted((i or "", hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)


def test_many_paths_on_one_host(spark):
    rng = random.Random(2)
    rules = [("h.net", f"/{i}/" + "x/" * (i % 3), ("allow", "block")[i % 2]) for i in range(20_000)] + [("net", "/", "block"), ("h.net", "/7", "allow"), ("h.net", "/7", "block")]
    urls = [f"http://{rng.choice(['', 'a.'])}h.net/{rng.randrange(25_000)}/{'x/' * rng.randrange(4)}y" for _ in range(2000)] + ["http://h.net/77"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = {}
    for _, p, v in (r for r in rules if r[0] == "h.net"):
        known[p] = "block" if "block" in (v, known.get(p)) else v
    for r in urlrules.judge(table, spark.createDataFrame(rules, "host string, path string, verdict string")).collect():
        best = max((r.path[:n] for n in range(len(r.path) + 1) if r.path[:n] in known), key=len, default=None)
        assert (r.rule, r.verdict) == (("net/", "block") if best is None else (f"h.net{best}", known[best]))


def similarity(a, b, k=5):
    import collections

    grams = lambda ws: collections.Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_long_items_with_repeated_words(spark):
    rng = random.Random(4)
    item = [rng.choice(["la", "di", "da"]) for _ in range(40)] + [f"w{rng.randrange(500)}" for _ in range(1960)]
    verse = "one two three four five six seven " * 8
    items = {1: item, 2: verse.split(), None: [f"n{i}" for i in range(30)]}
    docs = []
    for i in range(12):
        ws = list(items[(1, 2, None)[i % 3]])
        ws = ws[: len(ws) - rng.randrange(0, len(ws) // 8)] + ["la"] * rng.randrange(0, len(ws) // 8)
        docs.append((i, [f"d{rng.randrange(9)}" for _ in range(20)] + ws + [f"e{rng.randrange(9)}" for _ in range(20)]))
    table = spark.createDataFrame([(i, " ".join(ws), 1, 1, 1) for i, ws in docs], "doc_id long, text string, item long, h long, start long")
    bench = spark.createDataFrame([(k, " ".join(ws), "x") for k, ws in items.items()], "item_id long, text string, fp string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table, bench).collect()}
    want = {}
    for i, ws in docs:
        for k, it in items.items():
            best = max(similarity(ws[s : s + len(it)], it) for s in range(len(ws) - 4))
            if best >= 0.8:
                want[i, k] = best
    assert set(got) == set(want) and len(want) >= 8
    for (i, k), best in want.items():
        start = got[i, k].start
        assert got[i, k].similarity == pytest.approx(best) == similarity(docs[i][1][start : start + len(items[k])], items[k])


def test_only_anchored_pairs_are_compared(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    items = [text() for _ in range(300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{text()} {items[i]} {text()}") for i in range(0, 300, 3)], "doc_id long, text string")
    from pyspark.sql import functions as F

    found = decontaminate.candidates(docs.withColumn("text_hash", F.xxhash64("text")), decontaminate.items_of(bench), 0.8, F.broadcast)
    assert found.count() == 100  # each document with its own item, though all items are of one size
    assert decontaminate.leaks(docs, bench).count() == 100


def test_fits_on_repeated_and_contradicting_labels(spark):
    texts = ["good words in plain order here", "### $$$ !!! ### $$$"]
    docs = spark.createDataFrame([(i % 40, texts[i % 2] + f" {i}", 1, "y") for i in range(400)], "doc_id long, text string, y int, id string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(40)] + [(3, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = gam.train(docs, labels, max_rows=20), gam.train(docs.repartition(5), labels, max_rows=20)
    assert a.base == b.base and all((x == y).all() for x, y in zip(a.tables, b.tables))
    c, d = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels)
    assert c.bias == d.bias and (c.value == d.value).all()
    few = toxicity.train(docs, labels, max_buckets=1)
    assert len(few.index) <= len(c.index) + 20
    one = docs.where(f"doc_id = {next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5)}")
    assert gam.train(one, labels) is not None
