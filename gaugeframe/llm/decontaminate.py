"""Benchmark decontamination in DataFrame functions only.

Texts are lower-cased and cut into words (runs of letters, marks and digits). A benchmark item of m words is held
against windows of m words of every document; the pair is a leak if the multisets of their five-word shingles (the
whole sequence, where there are fewer words) have a weighted Jaccard similarity of at least ``similarity``.

1. Anchors: places of a document whose shingle is one of the item's. A window that is similar enough holds at least
   ``similarity`` times the item's shingles, so only (document, item) pairs with as many anchors go on.
2. Windows start at anchors: moving a window on to its first anchor never lowers the similarity. Only windows that
   hold enough anchors go on, each for the items whose anchors they are.
3. Each window and each item gets a 64-bit SimHash of its shingles, a repeated shingle being hashed with how often it
   came before, so that all that is summed is distinct. Fingerprints within ``RADIUS`` bits agree in one of
   ``RADIUS`` + 1 blocks of bits, so an equi-join over (item, block, value) finds all of them.
4. The pairs found are verified by their exact weighted similarity.

Steps 1, 2 and 4 lose nothing. In step 3 each bit of a pair at the similarity bound differs by itself with a chance of
at most 0.151, 9.7 bits of 64 on average; more than 27 differ for one such pair in 25 million (binomial tail 4.0e-8).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import bound, run_hashes

from .common import cut

TOKEN = r"([\p{L}\p{M}\p{N}]+)"
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 27
#: Rows of benchmark shingles up to which that side is broadcast (32 bytes each); beyond, the join is shuffled.
BROADCAST = 500_000
#: Texts with anchors enough up to whose number their list of ids and hashes is broadcast (24 bytes each); beyond, by shuffle.
MOST_TEXTS = 2_000_000
_WIDTHS = [3] * 8 + [2] * 20
BLOCKS = [(sum(_WIDTHS[:i]), (1 << w) - 1) for i, w in enumerate(_WIDTHS)]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def shingles(ws: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles of ``ws``, in order; none if there are fewer words."""
    return run_hashes(ws, k)


def simhash(hashes: Column) -> Column:
    """Majority of each bit over ``hashes``, repeats included. Two 32-bit counters share a sum."""
    lanes = F.lit(0x0000000100000001).cast("long")
    sums = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + _shift(h, b).bitwiseAND(lanes)))

    def gather(s: Column) -> Column:
        half = F.size(hashes)
        low = lambda x: (2 * x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) > half).cast("long")
        high = lambda x: (2 * F.shiftrightunsigned(x, 32) > half).cast("long")
        bits = F.transform(s, lambda x, i: _left(low(x), i).bitwiseOR(_left(high(x), i + 32)))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return bound(sums, gather)


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _left(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def numbered(hashes: Column) -> Column:
    """Each hash mixed with how often it came before, so that a multiset becomes a set, sorted by hash. Runs of equal
    hashes are found in the sorted array in one pass each, whatever repeats."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda h, i: F.when((i == 0) | (F.get(s, i - 1) != h), i)), lambda i: i.isNotNull())
        ends = lambda st: F.concat(F.slice(st, 2, F.size(st)), F.array(F.size(s)))
        return bound(starts, lambda st: F.flatten(F.zip_with(st, ends(st), lambda a, b: F.transform(F.sequence(F.lit(0), b - a - 1), lambda i: F.xxhash64(F.get(s, a), i)))))

    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(bound(F.array_sort(hashes), runs))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (a hash of id and words), k (shingle width), n (shingles), hashes, set and fp of each item with a
    word; equal rows once."""
    out = benchmark.select("item_id", tokens(F.col("text")).alias("ws")).where(F.size("ws") > 0).dropDuplicates()
    out = out.withColumn("item", F.xxhash64("item_id", "ws")).withColumn("k", F.least(F.size("ws"), F.lit(SHINGLE)))
    hashes = functools.reduce(lambda e, k: F.when(F.col("k") == k, shingles(F.col("ws"), k)).otherwise(e), range(1, SHINGLE + 1), F.array().cast("array<bigint>"))
    out = out.select("item_id", "item", "k", hashes.alias("hashes")).withColumn("n", F.size("hashes"))
    return out.withColumn("set", numbered(F.col("hashes"))).withColumn("fp", simhash(F.col("set")))


def block_of(fp: Column, i: int) -> Column:
    at, mask = BLOCKS[i]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(mask).cast("long"))


def blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), block_of(fp, i).alias("value")) for i in range(len(BLOCKS))])


def _first_equal(a: Column, b: Column) -> Column:
    """The first block in which two fingerprints agree: a pair is taken from that block alone."""
    x = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(block_of(x, i) == 0, F.lit(i)) for i in range(len(BLOCKS))])


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity and start (the word at which the best window starts) of every leak.

    Defined cases: null and empty texts and items leak nothing; long texts and items are looked at whole; rows of
    ``docs`` that repeat an id and a text count once; rows with the same id and other texts are each looked at; ids of
    documents and items may be null. Of equally good windows that start with a shingle of the item the first is named.
    Other columns are left out, whatever their names; empty tables give an empty result.
    """
    return _best(leaks_by_text(docs, benchmark, similarity), "doc_id", "item_id")


def _best(found: DataFrame, *key: str) -> DataFrame:
    best = found.groupBy(*key).agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"))).alias("best"))
    return best.select(*key, "best.similarity", (-F.col("best.back")).cast("int").alias("start"))


KEY = ["doc_id", "text_hash"]


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    """Of rows with KEY and rows with of and of_hash: the same document, which may have no id, and the same text."""
    return left["doc_id"].eqNullSafe(right["of"]) & (left["text_hash"] == right["of_hash"])


def candidates(texts: DataFrame, items: DataFrame, similarity: float, near: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Steps 1 and 2: doc_id, text_hash, item, k, n and the starts of the windows that may be similar enough to the item;
    None if no item has a word."""
    known = items.select("item", "k", "n", F.explode("hashes").alias("h")).distinct()
    found = None
    for k in sorted(r[0] for r in items.select("k").distinct().collect()):
        places = texts.select(*KEY, tokens(F.col("text")).alias("ws")).select(*KEY, F.posexplode(shingles(F.col("ws"), k)).alias("p", "h"))
        anchors = places.join(near(known.where(F.col("k") == k)), "h").groupBy(*KEY, "item", "k", "n").agg(F.array_sort(F.collect_set("p")).alias("at"))
        found = anchors if found is None else found.unionByName(anchors)
    if found is None:
        return None
    need = F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int")
    starts = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + F.col("need") - 1) - p < F.col("n"), F.lit(False)))
    return found.withColumn("need", need).where(F.size("at") >= F.col("need")).select(*KEY, "item", "k", "n", starts.alias("starts")).where(F.size("starts") > 0)


def leaks_by_text(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As ``leaks``, but a row for each text of an id: doc_id, text_hash (xxhash64 of the text), item_id, similarity, start."""
    items = cut(items_of(benchmark))
    small = items.agg(F.sum("n")).first()[0] or 0
    near = F.broadcast if small <= BROADCAST else lambda x: x
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").isNotNull())
    found = candidates(texts, items, similarity, near)
    if found is None:
        ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash")).limit(0).withColumn("item_id", F.lit(None).cast(dict(benchmark.dtypes)["item_id"]))
        return ids.withColumns({"similarity": F.lit(0.0), "start": F.lit(0)})
    found = cut(found)
    asked = found.select(*KEY, "item", "k", "n", F.explode("starts").alias("start"))

    # Only texts with anchors enough are cut into windows; items of the same size share windows.
    listed = found.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).distinct()
    listed = F.broadcast(listed) if listed.count() <= MOST_TEXTS else listed
    few = texts.join(listed, _same_text(texts, listed), "left_semi")
    starts = asked.groupBy(*KEY, "k", "n").agg(F.array_sort(F.collect_set("start")).alias("starts")).withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
    windows = few.join(starts, _same_text(few, starts)).drop("of", "of_hash")
    hashes = functools.reduce(lambda e, k: F.when(F.col("k") == k, shingles(F.col("ws"), k)).otherwise(e), range(1, SHINGLE + 1), F.array().cast("array<bigint>"))
    windows = windows.withColumn("ws", tokens(F.col("text"))).select(*KEY, "k", "n", "starts", hashes.alias("hashes"))
    windows = windows.select(*KEY, "k", "n", F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("hashes", s + 1, F.col("n")).alias("hashes")))).alias("w"))
    windows = windows.select(*KEY, "k", "n", "w.start", numbered(F.col("w.hashes")).alias("set")).dropDuplicates([*KEY, "k", "n", "start"])
    windows = cut(windows.withColumn("fp", simhash(F.col("set"))))

    place = ["k", "n", "start"]
    window = windows.withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash", **{c: f"w_{c}" for c in place}, "set": "w_set"})
    of_window = lambda rows: functools.reduce(Column.__and__, [rows[c] == window[f"w_{c}"] for c in place], _same_text(rows, window))
    # A file of start lists is small beside its rows: its size must not make them a broadcast.
    prints = asked.hint("merge").join(window.drop("w_set"), of_window(asked)).select(*KEY, "item", *place, "fp", F.explode(blocks(F.col("fp"))).alias("b")).select("*", "b.*").drop("b")
    there = items.select("item", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("b")).select("*", "b.*").drop("b")
    pairs = prints.join(near(there), ["item", "block", "value"])
    pairs = pairs.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (_first_equal(F.col("fp"), F.col("item_fp")) == F.col("block")))
    pairs = pairs.select(*KEY, "item", *place)
    pairs = pairs.join(near(items.select("item", "item_id", F.col("set").alias("item_set"))), "item")
    pairs = pairs.join(window.drop("fp"), of_window(pairs))
    common = F.size(F.array_intersect("w_set", "item_set"))
    exact = pairs.withColumn("similarity", common / (F.size("w_set") + F.size("item_set") - common)).where(F.col("similarity") >= similarity - 1e-12)
    return _best(exact, *KEY, "item_id")
