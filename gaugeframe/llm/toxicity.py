"""Toxicity by FTRL-proximal logistic regression over hashed words, bigrams and skip-grams.

Each coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero: what is sent to the
executors is a list of at most ``DIM`` (bucket, weight) pairs. A feature counts once a document, whatever its length.

The weights are fitted on the driver on at most ``max_rows`` labelled documents of ``max_buckets`` distinct buckets in
all, the first by a hash of the id; the executors hash the texts, so the driver gets buckets and no text, four bytes
each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, labelled, one_a_key

DIM = 1 << 20
#: Bytes that separate words: ASCII but letters and digits. Bytes of other scripts are parts of words.
BREAK = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_UNIGRAM, _BIGRAM, _SKIP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def buckets(text: bytes | None) -> np.ndarray:
    """Buckets of the words, pairs of neighbours and pairs with one word between, of a whole text; repeats remain."""
    ws = text.translate(BREAK).split() if text else []
    if not ws:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(zlib.crc32, ws), np.uint32, len(ws))
    parts = [h * _UNIGRAM, (h[:-1] * _BIGRAM) ^ (h[1:] * _UNIGRAM), (h[:-2] * _SKIP) ^ (h[2:] * _BIGRAM)]
    mixed = np.concatenate(parts)
    return (mixed ^ (mixed >> np.uint32(15))) % np.uint32(DIM)


@dataclass
class Model:
    bias: float
    index: np.ndarray
    value: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(DIM, np.float32)
        out[self.index] = self.value
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 3, seed: int = 5) -> Model:
    """FTRL-proximal, one row at a time. ``rows`` hold distinct buckets."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1 * (at < DIM), 0.0, -(z[at] - np.sign(z[at]) * l1 * (at < DIM)) / ((beta + np.sqrt(n[at])) / alpha + l2 * (at < DIM)))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], DIM).astype(np.int64)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    index = np.nonzero(w[:DIM])[0]
    slope, bias = _calibrated(np.array([w[r].sum() for r in rows]), y)
    return Model(bias, index.astype(np.int32), (slope * w[index]).astype(np.float32))


def _calibrated(sums: np.ndarray, y: np.ndarray, steps: int = 25) -> tuple[float, float]:
    """Slope and bias of a logistic fit of the labels to the sums: L1 has pulled the weights towards zero."""
    x = np.stack([sums, np.ones(len(sums))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * (w - [1, 0])
        w = w - np.clip(np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2), g), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, float(w[1]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 12000, max_buckets: int = 24_000_000) -> Model:
    """Fit on at most ``max_rows`` documents with a toxic label outside the held fold. Without any, every score is 0.

    An id that occurs on several rows is learned from once, from one of them; of labels that contradict each other the
    larger holds; null ids and labels are left out. Where the documents are so long that they have more than
    ``max_buckets`` buckets, the first of them by the hash that fit in are learned from, and one at least.
    """
    ids = bounded(labelled(docs.select("doc_id"), labels, "toxic", folds, held).distinct(), max_rows, "doc_id")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "x": [np.unique(buckets(t)).tobytes() for t in b["text"]]})

    counted = cut(one_a_key(rows.mapInPandas(count, "doc_id string, y int, x binary"), "doc_id").withColumn("h", F.xxhash64("doc_id")))
    room, last = max_buckets, None
    for r in sorted(counted.select("h", F.octet_length("x").alias("n")).collect()):
        room -= r["n"] // 4
        if room < 0 and last is not None:
            break
        last = r["h"]
    got = sorted(counted.where(F.col("h") <= F.lit(last)).collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not got:
        return Model(-30.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return fit([np.frombuffer(r["x"], np.uint32) for r in got], np.array([r["y"] for r in got], float))


def scorer(model: Model):
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        dense = model.dense()
        used = dense != 0

        def one(t: bytes | None) -> float:
            at = buckets(t)
            return model.bias + float(dense[np.unique(at[used[at]])].sum())

        z = np.array([one(t) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1).

    Defined cases: null and empty texts get the score of the bias alone; repeated rows get the same score, and so do
    texts with the same set of buckets; a long text is hashed whole; an empty table stays empty; an existing column
    ``toxicity`` is replaced, other columns are left alone.
    """
    return docs.withColumn("toxicity", scorer(model)(F.col("text").cast("binary")))
