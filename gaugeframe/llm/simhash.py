"""SimHash near-dedup with vantage-point trees.

Every text gets a 64-bit fingerprint. Two fingerprints link where they differ in at most ``radius`` bits. The
distinct fingerprints are dealt into shards by the upper levels of a vantage-point tree: at a node with pivot v and
boundary mu, what lies within mu + radius of v goes inward and what lies beyond mu goes outward, so a fingerprint
near the boundary goes both ways and, by the triangle bound, each linked pair meets in a shard. Within a shard the
tree goes on down to small leaves, which are compared exactly. A shard returns a forest over its linked
fingerprints, never all pairs; the forests are joined into components by distributed rounds of minimum labels.

A region so dense that no pivot splits it (near copies of near copies) is not compared pair by pair: two fingerprints
within an even radius are linked exactly if they share a fingerprint within half of it, so those are listed and sorted,
or, for a region larger than a shard, shuffled by that shared fingerprint so that no task holds the region.

Each level sends fingerprints near its boundary both ways, so copies grow with the levels above the shards. Shards
therefore grow with the table, from ``SHARD`` to ``MOST_SHARD`` (8 MB of fingerprints): what the tree does inside a
shard copies places in memory, not rows of a shuffle. Shards are numbered; the tree is four flat arrays of at most
``MOST_NODES`` nodes (18 bytes each), broadcast. Beyond that many nodes shards get larger and results stay the same.

Only a bounded sample of fingerprints (``SAMPLE`` to ``MOST_SAMPLE``, 8 bytes each) reaches the driver, to place
pivots; it decides about balance, not about results.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import sampling

from .common import cut

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints for placing pivots, as many as that at least and at most, with SAMPLED for each shard to come.
SAMPLE, MOST_SAMPLE, SAMPLED = 8192, 1 << 18, 16
#: The smallest and largest size of shard to aim for, and the shards to have before they grow.
SHARD, MOST_SHARD, SHARDS = 8192, 1 << 20, 64
#: The nodes of the tree, the fingerprints that are dealt at once, and the widest radius at which a dense region is
#: shuffled by shared neighbours (2081 of each fingerprint at 4).
MOST_NODES, DEALT, SPREAD = 1 << 20, 1 << 17, 4
#: The size of a leaf that is compared whole, of an unsplit region that is compared pair by pair, and the neighbours that
#: are sorted at once (8 bytes each).
LEAF, DENSE, AT_ONCE = 192, 4096, 1 << 23


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes up to which pieces are hashed together, and pieces at once (a row of 64 bits each).
TOGETHER, PIECES = 1024, 1 << 17


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _hash_equal(data: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the pieces of ``n`` bytes that start ``at`` places of ``data``, all at once."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    start, pos = np.full(len(at), seed, np.uint64), 0
    if n >= 32:
        lanes = [start + P1 + P2, start + P2, start, start - P1]
        while pos + 32 <= n:
            lanes = [_mix(v, eight[at + (pos + 8 * i)]) for i, v in enumerate(lanes)]
            pos += 32
        h = sum((_turn(v, by) for v, by in zip(lanes, (1, 7, 12, 18), strict=True)), np.zeros(len(at), np.uint64))
        for v in lanes:
            h = (h ^ _mix(np.uint64(0), v)) * P1 + P4
    else:
        h = start + P5
    h = h + np.uint64(n)
    for pos in range(pos, n - 7, 8):
        h = _turn(h ^ _mix(np.uint64(0), eight[at + pos]), 27) * P1 + P4
    pos = n - n % 8
    if n % 8 >= 4:
        h, pos = _turn(h ^ four[at + pos].astype(np.uint64) * P1, 23) * P2 + P3, pos + 4
    for pos in range(pos, n):
        h = _turn(h ^ data[at + pos].astype(np.uint64) * P5, 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start:end]`` for many pieces. Pieces of one length are hashed together by array operations; those
    longer than ``TOGETHER`` one by one."""
    import xxhash

    out, n = np.empty(len(starts), np.uint64), ends - starts
    padded = np.frombuffer(data + bytes(8), np.uint8)
    order = np.argsort(n, kind="stable")
    for group in np.split(order, np.nonzero(np.diff(n[order]))[0] + 1):
        size = int(n[group[0]]) if len(group) else 0
        if size <= TOGETHER:
            out[group] = _hash_equal(padded, starts[group], size, seed)
        else:
            out[group] = [xxhash.xxh64_intdigest(data[s:e], seed) for s, e in zip(starts[group].tolist(), ends[group].tolist(), strict=True)]
    return out


def _shingles(text: bytes | None, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by spaces, and where its shingles start and end."""
    ws = text.translate(LOWER).split() if text else []
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    if len(ws) <= size:
        return b" ".join(ws), np.zeros(min(len(ws), 1), np.int64), ends[-1:]
    return b" ".join(ws), np.concatenate([[0], ends[: len(ws) - size] + 1]), ends[size - 1 :]


def _ones(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in the runs of hashes that begin at ``starts``, none of them empty. Bits are added
    as bytes, eight at once, over up to 255 hashes, and those sums as numbers."""
    bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    parts = -(-np.diff(np.append(starts, len(hashed))) // 255)
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    sums = np.add.reduceat(bits, np.repeat(starts, parts) + 255 * within, axis=0).view(np.uint8)
    return np.add.reduceat(sums, first, axis=0, dtype=np.int64)


def many_fingerprints(texts: Iterable[bytes | None], shingle: int = 3, seed: int = 42) -> Iterator[int]:
    """The fingerprint of each text as a signed 64-bit integer: the majority of the bits of the shingles' XXH64, repeats
    included; 0 without words. Texts are hashed together up to ``PIECES`` shingles, longer ones in parts."""

    def flush(found: list[tuple[bytes, np.ndarray, np.ndarray]]) -> Iterator[int]:
        shift = np.cumsum([0, *(len(d) for d, _, _ in found)])
        sizes = np.array([len(s) for _, s, _ in found], np.int64)
        starts = np.concatenate([s + at for (_, s, _), at in zip(found, shift, strict=False)])
        ends = np.concatenate([e + at for (_, _, e), at in zip(found, shift, strict=False)])
        data, at = b"".join(d for d, _, _ in found), np.cumsum(sizes) - sizes
        ones = np.zeros((len(found), 64), np.int64)
        for i in range(0, len(starts), PIECES):
            own = np.nonzero((sizes > 0) & (at < i + PIECES) & (at + sizes > i))[0]
            ones[own] += _ones(hashes(data, starts[i : i + PIECES], ends[i : i + PIECES], seed), np.maximum(at[own] - i, 0))
        yield from np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel().tolist()

    held, pieces = [], 0
    for text in texts:
        held.append(_shingles(text, shingle))
        pieces += len(held[-1][1])
        if pieces >= PIECES or len(held) >= 4096:
            yield from flush(held)
            held, pieces = [], 0
    if held:
        yield from flush(held)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    return next(many_fingerprints([text], shingle, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint ``fp`` of every row; a null or empty text has 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.fromiter(many_fingerprints(b["text"]), np.int64, len(b))})

    kind = dict(docs.dtypes)["doc_id"]
    ids = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    if kind == "bigint" or kind == "int":  # nulls must not turn ids into floats
        return ids.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast(kind).alias("doc_id"), "fp")
    return ids.mapInPandas(run, f"doc_id {kind}, fp long")


def _distances(pivot: np.uint64, fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ pivot)


def _boundary(d: np.ndarray, radius: int) -> int:
    """The distance that leaves the larger side, with the band that goes both ways, as small as can be."""
    upto = np.cumsum(np.bincount(d, minlength=65 + radius))
    return int(np.maximum(upto[radius : 65 + radius], len(d) - upto[:65]).argmin())


def _split(pivots: np.ndarray, fps: np.ndarray, radius: int) -> tuple | None:
    """(pivot, mu, inside, outside) of the first pivot that leaves both sides clearly smaller, or None."""
    for pivot in pivots:
        d = _distances(pivot, fps)
        mu = _boundary(d, radius)
        inner, outer = d <= mu + radius, d > mu
        if outer.any() and max(inner.sum(), outer.sum()) <= 0.85 * len(fps):
            return pivot, mu, inner, outer
    return None


class Tree(NamedTuple):
    """The upper levels: the pivot and boundary of each node, and what lies inward and outward of it: a node's number, or
    the complement of a shard's. Shards below ``dense`` are those that no pivot splits."""

    pivot: np.ndarray
    mu: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    dense: int


def shard_size(n: int) -> int:
    """The size of shard to aim for among ``n`` fingerprints."""
    return max(SHARD, min(MOST_SHARD, n // SHARDS))


def top_tree(sample: np.ndarray, scale: float, radius: int, size: int | None = None) -> Tree:
    """A node is split, the largest first, as long as the sample, each point of which stands for ``scale`` fingerprints,
    says that it is larger than a shard of ``size``: dense regions go deeper."""
    size = size or SHARD
    nodes, shards, dense, order = [], [], [], itertools.count()
    todo = [(-len(sample), next(order), sample, -1, 2)]  # as it is popped: points, the node above it, and its side of that
    while todo:
        _, _, points, above, side = heapq.heappop(todo)
        large = len(points) * scale > size and len(points) >= 16
        found = _split(points[[0, len(points) // 3, 2 * len(points) // 3, -1]], points, radius) if large and len(nodes) < MOST_NODES else None
        if found is None:
            (dense if large and len(nodes) < MOST_NODES and radius % 2 == 0 and radius <= SPREAD else shards).append((above, side))
            continue
        pivot, mu, inner, outer = found
        if above >= 0:
            nodes[above][side] = len(nodes)
        nodes.append([pivot, mu, 0, 0])
        for to, at in ((2, inner), (3, outer)):
            heapq.heappush(todo, (-int(at.sum()), next(order), points[at], len(nodes) - 1, to))
    for number, (above, side) in enumerate(dense + shards):
        if above >= 0:
            nodes[above][side] = ~number
    column = lambda i, kind: np.array([node[i] for node in nodes], kind)
    return Tree(column(0, np.uint64), column(1, np.int16), column(2, np.int32), column(3, np.int32), len(dense))


def route(tree: Tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of fps in it): every pair within the radius shares a shard."""
    todo = [(0 if len(tree.pivot) else ~0, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield ~node, at
            continue
        d, mu = _distances(tree.pivot[node], fps[at]), tree.mu[node]
        todo += [(int(tree.inner[node]), at[d <= mu + radius]), (int(tree.outer[node]), at[d > mu])]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def neighbours(fps: np.ndarray, within: int) -> Iterator[np.ndarray]:
    """The fps with every choice of up to ``within`` bits flipped: an array for each choice."""
    for n in range(within + 1):
        for bits in itertools.combinations(range(64), n):
            yield fps ^ np.uint64(sum(1 << b for b in bits))


def shared(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of fps that join all fps within an even radius: those that have a neighbour within half of it in
    common. A part of all possible neighbours at a time, ``AT_ONCE`` of them or so."""
    each = sum(1 for _ in neighbours(fps[:1], radius // 2))
    parts = -(-len(fps) * each // AT_ONCE)
    for part in range(parts):
        seen, places = [], []
        for x in neighbours(fps, radius // 2):
            at = np.nonzero((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == part)[0]
            seen.append(x[at]), places.append(at)
        x, at = np.concatenate(seen), np.concatenate(places)
        order = np.argsort(x, kind="stable")
        x, at = x[order], at[order]
        same = np.nonzero(x[1:] == x[:-1])[0]
        yield at[same], at[same + 1]


def link(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct fps the place of the root of its component, over all pairs within the radius."""
    parent = np.arange(len(fps))

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = _find(parent, x), _find(parent, y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    def compare(at: np.ndarray) -> None:
        for i in range(0, len(at), LEAF):
            rows = at[i : i + LEAF]
            for j in range(i, len(at), 8 * LEAF):
                cols = at[j : j + 8 * LEAF]
                near = np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius
                first = near.argmax(0)  # links of a column to its first row suffice where rows are linked through columns
                hit = near.any(0)
                unite(rows[first[hit]], cols[hit])
                extra = near.copy()
                extra[first, np.arange(len(cols))] = False
                extra[:, ~hit] = False
                # Rows that share a column are joined once a row, by the first column that they share with another.
                r, c = np.nonzero(extra)
                if len(r):
                    roots = np.fromiter((_find(parent, x) for x in rows.tolist()), np.int64, len(rows))
                    apart = roots[r] != roots[first[c]]
                    unite(rows[r[apart]], cols[c[apart]])

    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            compare(at)
            continue
        found = _split(fps[at[[0, len(at) // 2, -1]]], fps[at], radius)
        if found is not None:
            todo += [at[found[2]], at[found[3]]]
        elif len(at) <= DENSE or radius % 2:
            compare(at)
        else:
            for a, b in shared(fps[at], radius):
                for i in range(0, len(a), 1 << 16):
                    roots = _roots(parent)
                    x, y = roots[at[a[i : i + (1 << 16)]]], roots[at[b[i : i + (1 << 16)]]]
                    unite(x[x != y], y[x != y])
    return _roots(parent)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a < b, of forests that join all fingerprints of ``distinct`` within the radius."""
    n = distinct.count()
    size = shard_size(n)
    wanted = int(min(MOST_SAMPLE, max(SAMPLE, SAMPLED * n / size)))
    # Hashes are uniform: a task sends the driver its share of the sample and no more.
    share, at = min(1.0, (1.5 * wanted + 64) / max(n, 1)), F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 32))
    few = distinct.where(at < share * float(1 << 32)).orderBy(at, "fp").limit(wanted).collect()
    sample = np.array([r["fp"] for r in few], np.int64).view(np.uint64)
    tree = top_tree(sample, n / max(1, len(sample)), radius, size)
    sent = distinct.sparkSession.sparkContext.broadcast(tree)

    def frame(dealt: list[tuple[int, np.ndarray]], fps: np.ndarray) -> pd.DataFrame:
        shards, places = zip(*dealt, strict=True)
        return pd.DataFrame({"shard": np.repeat(np.array(shards, np.int32), [len(at) for at in places]), "fp": fps[np.concatenate(places)]})

    def spread(fps: np.ndarray) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for shard, places in route(sent.value, fps.view(np.uint64), radius):
            held.append((shard, places))
            rows += len(places)
            if rows >= DEALT:
                yield frame(held, fps)
                held, rows = [], 0
        if held:
            yield frame(held, fps)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            held.append(b["fp"].to_numpy())
            if sum(map(len, held)) >= DEALT:
                yield from spread(np.concatenate(held))
                held = []
        if held:
            yield from spread(np.concatenate(held))

    def join(b: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(b["fp"].to_numpy())
        root = fps[link(fps.view(np.uint64), radius)]
        return pd.DataFrame({"a": np.minimum(fps, root), "b": np.maximum(fps, root)})[fps != root]

    # A partitioning asked for by number isn't merged again: fingerprints and shards are small in bytes and long in work.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(parts, "fp").mapInPandas(deal, "shard int, fp long")
    if not tree.dense:
        return dealt.repartition(parts, "shard").groupBy("shard").applyInPandas(join, "a long, b long").distinct()
    dealt = cut(dealt)
    split = dealt.where(F.col("shard") >= tree.dense).repartition(parts, "shard").groupBy("shard").applyInPandas(join, "a long, b long")
    return split.union(dense_links(dealt.where(F.col("shard") < tree.dense).select("fp").distinct(), radius)).distinct()


def dense_links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a < b, that join all of the distinct fingerprints within an even radius, without a task that holds
    them: each goes to its neighbours within half of the radius, and those that meet at one are linked to the least of
    them. No more meet than a fingerprint has neighbours."""
    masks = [int(x.view(np.int64)[0]) for x in neighbours(np.zeros(1, np.uint64), radius // 2)]
    meet = fps.select("fp", F.explode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    met = meet.groupBy("at").agg(F.collect_list("fp").alias("of"), F.min("fp").alias("a")).where(F.size("of") > 1)
    return met.select("a", F.explode("of").alias("b")).where("a < b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge."""
    return sampling.components(edges, "a", "b")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) and root of every row of ``docs``.

    ``root`` is the smallest fingerprint of the component and tells components apart where an id is on rows of
    several. Defined cases: null and empty texts have fingerprint 0 and link like any other; a long text is hashed
    whole; repeated rows come back as often as they come; null ids get the component of their fingerprint and never
    name one: a component without any id has none; other columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    fps = cut(fingerprints(docs))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    to = named.join(least, "root").select("fp", "component_id", "root")
    return fps.join(to, "fp").select("doc_id", "fp", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
