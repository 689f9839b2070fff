"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into at most ``BINS`` bins. Boosting goes round the features in a cycle; each step fits
a tree of up to three leaves to one feature alone and adds a small part of it to that feature's lookup table. Then
the pairs of features with the largest gain left get tables of their own from four-leaf trees. A score is the
logistic of a sum of table entries, so scoring is one ``searchsorted`` and one table read a feature.

The tables are fitted on the driver on at most ``max_rows`` labelled rows, the first by a hash of the id; the
executors measure the texts, so the driver gets a few numbers a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, labelled, one_a_key, slices

BINS, COARSE = 32, 8
FEATURES = ["words", "word_length", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "wide", "distinct", "adjacent", "repeated_lines", "line_words", "lower_lines", "longest_word"]
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~=+_[]{}\\/", "|", "!?", ".,;:'\"()-"]
_CLASS = np.zeros((256, len(_GROUPS) + 2), np.float64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _group], _k] = 1
_CLASS[128:, len(_GROUPS)] = 1
_CLASS[[9, 10, 11, 12, 13, 32], len(_GROUPS) + 1] = 1


def measure(text: bytes | None) -> list[float]:
    """The features of a whole text; of a null or empty one all are 0."""
    ws = text.split() if text else []
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    upper, digit, symbol, pipe, exclaim, stop, wide, space = counts.tolist()
    chars = max(1.0, len(text) - space)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    adjacent = sum(map(bytes.__eq__, ws, ws[1:]))
    return [
        float(n),
        chars / n,
        *(x / chars for x in (upper, digit, symbol, pipe, exclaim, stop, wide)),
        len(set(ws)) / n,
        adjacent / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(97 <= x[0] <= 122 for x in lines) / len(lines),
        float(max(map(len, ws))),
    ]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.raw(self.bins(x)))


def _leaf(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """(value, gain) of leaves with these sums of gradients and curvatures."""
    v = g / (h + shrink)
    return v, g * v


def _tree(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    """A table: the best tree of up to three leaves over ordered bins."""
    n = len(g)
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    a, b = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    gain = _leaf(G[a], H[a], shrink)[1] + _leaf(G[b] - G[a], H[b] - H[a], shrink)[1] + _leaf(G[n] - G[b], H[n] - H[b], shrink)[1]
    gain[a > b] = -np.inf
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(n)
    for lo, hi in ((0, i), (i, j), (j, n)):
        if hi > lo:
            out[lo:hi] = _leaf(G[hi] - G[lo], H[hi] - H[lo], shrink)[0]
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, shrink: float) -> tuple[np.ndarray, float]:
    """(table, gain): the best pair of cuts of a two-way table, a leaf for each quadrant."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda S: (S[:-1, :-1], S[:-1, -1:] - S[:-1, :-1], S[-1:, :-1] - S[:-1, :-1], S[-1, -1] - S[:-1, -1:] - S[-1:, :-1] + S[:-1, :-1])
    gain = sum(_leaf(x, y, shrink)[1] for x, y in zip(quarter(G), quarter(H), strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum(), shrink)[0]
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.15, shrink: float = 4.0) -> Model:
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(share / (1 - share))))
    b = m.bins(x)
    z = m.raw(b)
    for _ in range(rounds):
        for k, t in enumerate(m.tables):
            p = _logistic(z)
            step = rate * _tree(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)), shrink)
            t += step
            z += step[b[:, k]]
    coarse = [(np.arange(len(t)) * COARSE // len(t)) for t in m.tables]

    def two_way(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = coarse[i][b[:, i]] * COARSE + coarse[j][b[:, j]]
        p = _logistic(z)
        return at, np.bincount(at, y - p, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, p * (1 - p), COARSE**2).reshape(COARSE, COARSE)

    gains = {(i, j): _quadrants(*two_way(i, j)[1:], shrink)[1] for i in range(len(cuts)) for j in range(i)}
    best = sorted(gains, key=lambda k: (-gains[k], k))[:pairs]
    small = {k: np.zeros((COARSE, COARSE)) for k in best}
    for _ in range(pair_rounds):
        for i, j in best:
            at, g, h = two_way(i, j)
            step = rate * _quadrants(g, h, shrink)[0]
            small[i, j] += step
            z += step.reshape(-1)[at]
    m.pairs = [(i, j, t[np.ix_(coarse[i], coarse[j])]) for (i, j), t in small.items()]
    return m


def measured(docs: DataFrame) -> DataFrame:
    """doc_id as text and the features of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(x=[measure(t) for t in b["text"]])

    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(keep).dtypes), "x array<double>"])
    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInPandas(run, schema)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = 12000) -> Model | None:
    """Fit on at most ``max_rows`` documents with a quality label outside the held fold; None if there are none.

    An id that occurs on several rows is learned from once, from one of them; of labels that contradict each other
    the larger holds; null ids and labels are left out.
    """
    ids = bounded(labelled(docs.select("doc_id"), labels, "quality", folds, held).distinct(), max_rows, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "y", "text")
    got = sorted((r["id"], r["y"], r["x"]) for r in cut(one_a_key(measured(rows), "id")).collect())
    if not got:
        return None
    return fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))


def scorer(model: Model | None):
    """An Arrow function of texts as bytes. Only a slice of a batch at a time is turned into Python's bytes."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(text), 0.5))
        parts = [model.score(np.array([measure(t) for t in text[s].to_pylist()], float)) for s in slices(len(text))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``quality_score`` (0 to 1).

    Defined cases: null and empty texts get the score of all-zero features; without any label every score is 0.5;
    repeated rows get the same score, and so do texts that tie in all features' bins; a long text is measured whole;
    an empty table stays empty; an existing column ``quality_score`` is replaced, other columns are left alone.
    """
    return docs.withColumn("quality_score", scorer(model)(F.col("text").cast("binary")))
