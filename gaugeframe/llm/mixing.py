"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words; a document's expected number of copies is target / size of the source, the same
for all its documents. The whole part is taken; the fractions are rounded in pairs: of two fractional documents one
gives its mass in words to the other until one of them is integral, which of them by a coin weighted so that each
keeps its expectation. The words of a source then differ from its target by less than one document.

A source is dealt by a hash of its rows into chunks of about ``CHUNK``; every chunk leaves one residual, and residuals
are rounded among each other ``FAN`` at a time, level by level, until one is left. Rows that repeat each other are
counted first and numbered, and the number is part of the hash, so that they are spread like others. Coins are hashes
of the rows, their numbers and a seed, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

CHUNK, FAN = 1024, 64
#: Sources at most: the driver holds a name and a size of each, about 100 bytes. More is an error, not a cut.
MOST_SOURCES = 2_000_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """The target of each source: ``share`` of all words by weight, none above ``most`` times its size, the excess
    reshared by weight among the others until none is above. Sources go by code point, null last."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] > most * size[s] * total]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = most * size[s]
        left = max(0.0, left - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in full]
    return out


def coin(seed: int, *parts: object) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest(), "big") / 2**64


def pivot(rows: list[tuple[int, int, float]], seed: int) -> tuple[dict[int, int], tuple[int, float] | None]:
    """Round (key, size, fraction) rows in their order: ({place: 0 or 1}, (place, fraction) of the residual or None)."""
    done: dict[int, int] = {}
    i, p = -1, 0.0
    for j, (key, size, q) in enumerate(rows):
        if i < 0:
            i, p = j, q
        else:
            a, b = rows[i][1], size
            mass = p * a + q * b
            up_i, low_i = min(1.0, mass / a), max(0.0, (mass - b) / a)  # all that i can take, or all that j can
            chance = 1.0 if up_i == low_i else (p - low_i) / (up_i - low_i)
            p = up_i if coin(seed, rows[i][0], key) < chance else low_i
            q = min(1.0, max(0.0, (mass - p * a) / b))
            if p <= 1e-12 or p >= 1 - 1e-12:
                done[i] = int(p > 0.5)
                i, p = j, q
            else:
                done[j] = int(q > 0.5)
        if i >= 0 and (p <= 1e-12 or p >= 1 - 1e-12):
            done[i] = int(p > 0.5)
            i = -1
    return done, (i, p) if i >= 0 else None


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``.

    Defined cases: a null or empty text has size 0 and takes nothing; a long one counts whole; a null source is one of
    its own and comes last; repeated rows, however many, are rounded one by one; null ids are rows like others. Other
    columns are not looked at, whatever their names. An empty table gives an empty result; more than ``MOST_SOURCES``
    sources are an error.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sized = cut(numbered(sized))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    stats = totals.limit(MOST_SOURCES + 1).collect()  # a row a source
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    goal = targets([(r["source"], r["source_size"]) for r in stats], weights, share, most)
    most_chunks = max((-(-r["rows"] // CHUNK) for r in stats), default=1)
    shape = "source string, source_size long, target double, chunks int"
    known = docs.sparkSession.createDataFrame([(r["source"], r["source_size"], float(goal[r["source"]]), -(-r["rows"] // CHUNK)) for r in stats], shape)
    named = known.withColumnRenamed("source", "of")
    dealt = sized.join(F.broadcast(named) if len(stats) <= 10_000 else named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = dealt.withColumn("expected", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    dealt = dealt.withColumn("whole", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.floor("expected"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(seed)), F.col("chunks").cast("long"))).drop("chunks", "expected")
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    parts = [dealt.where(~fractional).withColumn("done", F.lit(0))]
    open_ = dealt.where(fractional)
    levels = 1 + max(0, math.ceil(math.log(most_chunks, FAN)))
    for level in range(levels):
        step = cut(_rounded(open_, seed, level == levels - 1))
        parts.append(step.where("done >= 0"))
        open_ = step.where("done < 0").drop("done").withColumn("chunk", F.floor(F.col("chunk") / FAN).cast("long"))
    every = functools.reduce(DataFrame.unionByName, parts).withColumn("copies", F.col("whole") + F.col("done"))
    return every.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, h) with h mixed with a number where rows repeat each other, from the second on.

    Equal rows are counted where they are and dealt out again ``CHUNK`` at a time, so that no task gets all of them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    single = counted.where("n = 1").drop("n")
    many = counted.where("n > 1").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    many = many.repartition("h", "piece").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("piece") * CHUNK) - 1)))
    at = F.col("piece") * CHUNK + F.col("i")
    return single.unionByName(many.withColumn("h", F.when(at > 0, F.xxhash64("h", at)).otherwise(F.col("h"))).select(*rows.columns))


def _rounded(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """``rows`` with done: 0 or 1, or -1 for the residual of a chunk, whose p is then what is left of it. In the last
    level each chunk is a whole source and its residual falls by a coin."""
    kinds = dict(rows.dtypes)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["h", "size", "doc_id"], kind="stable", ignore_index=True)
        done, rest = pivot(list(zip(b["h"].tolist(), b["size"].tolist(), b["p"].tolist(), strict=True)), seed)
        out, p = np.full(len(b), -1, np.int32), b["p"].to_numpy(copy=True)
        for i, x in done.items():
            out[i] = x
        if rest:
            p[rest[0]] = rest[1]
            if last:
                out[rest[0]] = int(coin(seed, "last", int(b["h"][rest[0]])) < rest[1])
        return b.assign(p=p, done=out)

    sent = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids beside nulls
    schema = ", ".join([*(f"{c} {t}" for c, t in sent.dtypes), "done int"])
    back = sent.groupBy("source", "chunk").applyInPandas(run, schema)
    return back.withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"]))
