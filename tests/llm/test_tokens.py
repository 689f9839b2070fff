"""Periodic runs, streaming BPE and the alignment of tokenizers: against brute force, the libraries and plain loops."""

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gaugeframe.llm import align, bpe, queries, runs

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [None, "", " \n\t ", "a", "a a a a a a", "é ü ß", "x " * 5000, "one two " * 4 + "three", "<|endoftext|> don't 'STOP' <0x41> ▁ \x00", "日本語のテキスト" * 3, "Σας ΟΔΟΣ İ ŉ", "w" * 20000, "😀" * 50 + "!?" * 50]
SCHEMA = "doc_id long, text string, periodic string, ids string, decoded int, chunk long, pairs string, _text string, _keep0 int, groups string, n_a int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 4 else i, t, "x", "y", 0, 1, "p", "t", 2, "g", 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def plain_runs(w, exponent, shortest):
    out, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], np.array(w[q:]) == np.array(w[:-q]), [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for i, j in edges.tolist():
            if j + q - i >= max(shortest, exponent * q):
                out.setdefault((i, j + q), q)
    return sorted(((i, j, q) for (i, j), q in out.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    w = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 3)):
        a, p, times = r.randrange(60), r.randint(1, 6), r.randint(2, 7)
        unit = w[a : a + p]
        w[a : a + len(unit) * times] = unit * times
    return w


@pytest.mark.parametrize("exponent, shortest", [(2, 2), (3, 2), (4, 6)])
def test_runs_of_random_words(exponent, shortest):
    r = random.Random(exponent)
    for _ in range(1500):
        w = random_words(r)
        want = plain_runs(w, exponent, shortest)
        assert runs.runs_of(w, exponent, shortest) == want
        assert runs.runs_of_words([b"%d" % x for x in w], exponent, shortest) == want


def test_factors_are_the_longest_that_began_before():
    r = random.Random(9)
    for _ in range(500):
        w = random_words(r)[:40]
        start = 0
        for end, source in runs.factors(w):
            reach = [next((k for k in range(len(w) - start) if w[v + k] != w[start + k]), len(w) - start) for v in range(start)]
            assert end - start == max([1, *reach])
            assert (source < 0) == (not any(reach)) and (source < 0 or (source < start and w[source : source + end - start] == w[start:end]))
            start = end
        assert start == len(w)


def test_runs_take_time_by_length():
    a, b = [0], [0, 1]
    while len(b) < 40_000:
        a, b = b, b + a
    # A Fibonacci word of length F(n) has 2 F(n - 2) - 3 runs.
    assert len(runs.runs_of(b)) == 2 * (len(b) - len(a)) - 3
    assert runs.runs_of([0] * 50_000, 4, 6) == [(0, 50_000, 1)]


def test_periodic_runs_on_odd_rows(odd):
    got = runs.periodic_runs(odd).select("text", "chunk", "periodic.*").collect()
    assert len(got) == odd.count() and all(r.chunk == 1 for r in got)
    for r in got:
        ws = (r.text or "").split(" ") if r.text and r.text.strip() else []
        ws = [x for w in ws for x in w.split("\n") if x.strip("\t")]
        want = plain_runs([ws.index(x) for x in ws], 4, 6) if len(ws) < 1000 else [(0, 5000, 1)]
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == want and r.n_words == len(ws)
        drop = {k for i, j, q in want for k in range(i + q, j)}
        assert r.collapsed == " ".join(x for k, x in enumerate(ws) if k not in drop)
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, exponent=1)


def test_op11_by_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        ws = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(ws)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [x if i < a else ws[a + (i - a) % p] for i, x in enumerate(ws)]
        if n > 3000:
            continue
        places = {}
        found = plain_runs([places.setdefault(x, len(places)) for x in ws], 4, 6)
        r, some = got[doc_id], some + len(found)
        top = min(found, key=lambda x: (-(x[1] - x[0]) / x[2], x[0], x[2]), default=None)
        want = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        drop = {k for i, j, q in found for k in range(i + q, j)}
        assert r.runs_sha256 == sha("".join(f"{i},{j - i},{q}\n" for i, j, q in found))
        assert r.collapsed_sha256 == sha(b" ".join(x for k, x in enumerate(ws) if k not in drop))
    assert some > 10


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(WORDS)
    lib.no_truncation()
    lib.no_padding()
    return lib


def test_streams_cut_anywhere(library):
    r, of, back = random.Random(2), bpe.tokenizer(WORDS), bpe.Decoder(bpe.tokenizer(WORDS).tokens, " ")
    parts = ["a", "b", "the", " ", "'", "'s", "'re", "'l", "ll", "!", "..", "1", "½", "é", "é", "ß", "Σ", "İ", "<|endoftext|>", "<|startoftext|>", "<|end", "\n", "　", "中文", "가", "가", "́", "👍🏽", "A", "TH", "ing", "</w>", "_"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randint(0, 8)))
        chunks = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert of.encode(text) == want and list(of.stream(chunks, block=8)) == want, text
        assert back.feed(want[:3]) + back.feed(want[3:]) + back.finish() == library.decode(want, skip_special_tokens=False)


def test_long_pieces_are_merged_in_blocks(library):
    r, of = random.Random(3), bpe.tokenizer(WORDS)
    texts = ["".join(r.choice("etaoinshr") for _ in range(30_000)), "ab" * 15_000, "é" * 9000, "".join(r.choice("!?.-*#'") for _ in range(9000)), "the" * 9000 + "<|endoftext|>" + "in" * 9000]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert of.encode(text) == want and list(of.stream([text], block=64)) == want


def test_a_piece_holds_no_more_than_a_block_and_the_lookahead():
    merges = bpe.tokenizer(WORDS).merges
    piece, most, size = bpe.Piece(merges, 64), 0, max(merges.size.values())
    for part in ["inthean" * 10] * 400:
        list(piece.feed(part))
        most = max(most, len(piece.held))
    assert most <= 2 * 64 + merges.lookahead + size


def test_lookahead_of_small_lists():
    # "ab" waits for c only: (b, c) comes first and takes b. With (c, d) before both, d matters too.
    one = {c: 1 for c in "abcd"}
    assert bpe.sufficient_lookahead([("a", "b")], one) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")], one) == 2
    assert bpe.sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], one) == 3
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c"), ("c", "d")], one) == 1
    for wrong in ([("ab", "c")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError, match="proper"):
            bpe.sufficient_lookahead(wrong, one)


def test_lookahead_settles_tokens_of_random_lists():
    r = random.Random(4)
    for _ in range(60):
        vocab = {}
        for s in bpe.byte_symbols():
            vocab[s], vocab[s + "/"] = len(vocab), len(vocab) + 1
        merges, known = [], ["a", "b", "c", "d"]
        while len(merges) < r.randint(3, 14):
            u, v = r.choice(known), r.choice(known)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                known.append(u + v)
        of = bpe.Merges(vocab, merges, "/")
        for _ in range(60):
            data = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 60)))
            whole = of.merge([of.inner[b] for b in data])
            assert of._merge_many([of.inner[b] for b in data]) == whole
            cut, end = r.randint(0, len(data)), 0
            for i, t in enumerate(of.merge([of.inner[b] for b in data[:cut]])):
                end += of.size[t]
                if end <= cut - of.lookahead:
                    assert whole[i] == t


def test_bpe_on_odd_rows(odd, library):
    coded = bpe.decode(bpe.encode(odd, WORDS), WORDS, text="again")
    assert sorted(coded.columns) == sorted([*odd.columns, "again"]) and coded.limit(0).count() == 0
    both = bpe.encode(odd, WORDS, decoded="decoded")
    assert sorted(both.columns) == sorted(odd.columns)
    got = coded.select("text", "ids", "again").collect()
    assert len(got) == odd.count() and sorted(map(str, got)) == sorted(str(r).replace("decoded=", "again=") for r in both.select("text", "ids", "decoded").collect())
    for text, ids, decoded in got:
        assert list(ids) == library.encode(text or "", add_special_tokens=False).ids and decoded == library.decode(list(ids), skip_special_tokens=False)
    with pytest.raises(ValueError, match="word ends"):
        bpe.Tokenizer(BYTES)


def test_op12_like_the_library(spark, sf, docs, library):
    got = {r.doc_id: r for r in queries.op12_streaming_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids, r = library.encode(text or "", add_special_tokens=False).ids, got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_owners_of_tokens():
    at_a, at_b, a_ends, b_ends = align.owners(np.array([1, 3, 2]), np.array([2, 2, 1, 1]))
    assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]
    assert (a_ends.tolist(), b_ends.tolist()) == ([2, 3], [2, 4])


def test_places_are_packed():
    at, times = np.array([0, 3, 4, 900]), np.array([1, 70000, 2, 1])
    assert [x.tolist() for x in align.unpack(align.pack(at, times))] == [at.tolist(), times.tolist()]
    assert [len(x) for x in align.unpack(align.pack(at[:0], times[:0]))] == [0, 0]


def by_offsets(texts):
    """The contract of op13 with plain loops over byte ranges."""
    lib, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lib.encode_special_tokens = True
    back = {s: b for b, s in enumerate(bpe.byte_symbols())}
    with open(BYTES, encoding="utf-8") as f:
        spelled = {i: bytes(back[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if all(c in back for c in t)}
    found, counts = [], collections.Counter()
    for text in texts:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        sides = [spelled[i] for i in a], [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            a, b, sides = [], [], ([], [])
        ranges = [[], []]
        for side, out in zip(sides, ranges, strict=True):
            at = 0
            for piece in side:
                out.append((at, at + len(piece)))
                at += len(piece)
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        links, j = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and ranges[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups = ";".join("|".join(",".join(str(x) for x, (_, e) in zip(ids, r, strict=True) if lo < e <= hi) for ids, r in ((a, ranges[0]), (b, ranges[1]))) for lo, hi in zip([0, *ends], ends, strict=False))
        counts.update(links)
        found.append((len(a), len(b), len(ends), links, sha(groups) if a else ""))
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest) for n_a, n_b, n_groups, links, digest in found]


OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op13_by_offsets(spark, sf, docs):
    got = {r.doc_id: tuple(r[c] for c in OUT) for r in queries.op13_owner_alignment(spark, sf).collect()}
    assert got == dict(zip([d for d, _ in docs], by_offsets([t for _, t in docs]), strict=True))


@pytest.mark.parametrize("chunk", [100, align.CHUNK])
def test_alignment_of_odd_rows(odd, chunk):
    from pyspark.sql import functions as F

    from gaugeframe.llm.common import cut

    stored = cut(align.align(odd, BYTES, PIECES, keep=("doc_id", "text", "_keep0", "n_a"), chunk=chunk).withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")))
    width = len(align.piece_vocabulary(PIECES).pieces)
    got = align.link_scores(stored.withColumns({"n_b": F.size("b_ids"), "count_a": F.size("a_ids")}), align.pair_counts(stored, width), ("text", "count_a", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")).collect()
    assert len(got) == odd.count() and all(r.n_a == 3 for r in got)
    texts = [r.text for r in got]
    assert sorted(map(str, texts)) == sorted(str(r.text) for r in odd.select("text").collect())
    assert [(r.count_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got] == by_offsets(texts)
    assert align.align(odd.limit(0), BYTES, PIECES).count() == 0
