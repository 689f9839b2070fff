"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic model over hashed byte n-grams (one to three bytes of
the lower-cased text) predicts it; a document gets the language whose codeword has the least loss against the
predicted bits, a wrong bit weighing by how sure its model is (log loss). Where the two nearest codewords are nearly
as good, the document is flagged as ambiguous.

Every language that the table names is learned. The models are fitted on the driver on at most ``per_language`` rows
a language and ``max_rows`` in all (one a language at least), the first by a hash of the row; texts are counted on the
executors, and the driver gets ``DIM`` counts a sampled row.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold, hash_below, slices

#: Buckets of hashed n-grams; bits of a codeword beyond seven languages.
DIM, BITS = 4096, 31
#: Languages up to which the list of their shares is broadcast.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
LETTER = r"\p{L}"


def histogram(text: str | None) -> np.ndarray:
    """Square-rooted, length-normalised counts of the hashed 1- to 3-grams of a whole text's bytes."""
    out = np.zeros(DIM, np.float32)
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8) if text else np.zeros(0, np.uint8)
    if not len(raw):
        return out
    raw = np.where((raw < 97) & (raw != 32), np.where((raw == 10) | (raw == 9) | (raw == 13), 32, 33), raw).astype(np.uint32)
    counts = np.bincount(raw, minlength=DIM)
    for n in (2, 3):
        if len(raw) >= n:
            h = raw[: len(raw) - n + 1]
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ raw[k : len(raw) - n + 1 + k]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            counts = counts + np.bincount(h, minlength=DIM)
    out[:] = np.sqrt(counts)
    return out / np.linalg.norm(out)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Up to seven languages: every way to split them in two. More: the random code with the widest least distance,
    of ``BITS`` bits or, for many languages, six times as many as would number them."""
    if n <= 7:
        rows = [(1, *rest) for rest in itertools.product((0, 1), repeat=n - 1) if 0 in rest] if n > 1 else [(1,)]
        return np.array(rows, np.int8).T
    rng = np.random.default_rng(seed)
    width = max(BITS, 6 * (n - 1).bit_length())

    def least(code: np.ndarray) -> int:
        signs = 2.0 * code - 1
        return min(int(((width - signs[at] @ signs.T) / 2 + width * (np.arange(n)[at][:, None] == np.arange(n))).min()) for at in slices(n, 1024))

    tried = (rng.integers(0, 2, (n, width), np.int8) for _ in range(max(2, min(200, 20_000_000 // n**2))))
    return max(tried, key=least)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the nearest codeword, its share of the likelihood, the lead over the next one in bits of loss)."""
        z = np.clip(x @ self.weights + self.bias, -30, 30)
        loss = np.logaddexp(0, -z) @ self.code.T.astype(np.float32) + np.logaddexp(0, z) @ (1 - self.code.T).astype(np.float32)
        loss /= self.code.shape[1]
        order = np.sort(loss, axis=1)
        lead = (order[:, 1] - order[:, 0]) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        e = np.exp(-4 * (loss - order[:, :1]))
        return loss.argmin(1), 1 / e.sum(1), lead


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 300, rate: float = 2.0, decay: float = 1e-5) -> Model:
    """All bits at once: full-batch logistic regression with momentum, languages weighing alike."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    each = (1.0 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    each /= each.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - target) * each[:, None]
        vw, vb = 0.9 * vw - rate * (x.T @ g + decay * w), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    return Model(languages, code, w, b)


def train(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = 600, max_rows: int = 12000) -> Model | None:
    """Fit on rows with text and lang outside the held fold; None if there are none.

    Rows that repeat an id, a text and a language count once. The model doesn't depend on how the rows are dealt.
    """
    h = F.xxhash64("doc_id", "text", "lang", F.lit(3))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (fold(F.col("doc_id"), folds) != held)).withColumn("_h", h)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    most = max(1, min(per_language, max_rows // len(counts)))
    # Hashes are uniform: those below twice the share that is wanted hold the first ``most`` of each language.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (2.0 * most + 64.0) / n)) for k, n in sorted(counts.items())], "lang string, share double")
    ids = rows.select("lang", "_h").join(F.broadcast(shares) if len(counts) <= MOST_BROADCAST else shares, "lang").where(hash_below(F.col("_h"), F.col("share"))).select("lang", "_h").distinct()
    near = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("r") <= most)
    near = near.select(F.col("_h").alias("_key"))
    chosen = rows.select("lang", "text", "_h").join(F.broadcast(near), F.col("_h") == F.col("_key"), "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "h": b["_h"], "x": [histogram(t).astype(np.float16).tobytes() for t in b["text"]]})

    counted = cut(chosen.mapInPandas(count, "lang string, h long, x binary"))
    got = sorted(counted.dropDuplicates(["lang", "h"]).collect(), key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    place = {k: i for i, k in enumerate(languages)}
    return fit(x, np.array([place[r["lang"]] for r in got]), languages)


def scorer(model: Model | None, ambiguous: float):
    """An Arrow function of texts and whether they have a letter: (lang_pred, score, ambiguous). Only a slice of a batch
    at a time is turned into Python's texts."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def run(text: pa.Array, letter: pa.Array) -> pa.Array:
        n = len(text)
        pred, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        at = np.nonzero(letter.to_numpy(zero_copy_only=False))[0] if model else np.zeros(0, int)
        for s in slices(len(at)):
            best, share, lead = model.decode(np.stack([histogram(t) for t in text.take(pa.array(at[s])).to_pylist()]))
            pred[at[s]], score[at[s]], unsure[at[s]] = np.array(model.languages, object)[best], np.minimum(share, 1.0), lead < ambiguous
        return pa.StructArray.from_arrays([pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(unsure)], ["lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model | None, ambiguous: float = 0.05) -> DataFrame:
    """``docs`` with a struct column ``language`` of lang_pred, score and ambiguous.

    Defined cases: a null text or one without a letter is ``und`` with score 0 and flagged; so is every row if there
    was nothing to learn from. Repeated rows get the same answer; of languages whose codewords are equally near the
    first by name is taken, and the row is flagged; a long text is counted whole; an empty table stays empty; an
    existing column ``language`` is replaced, other columns are left alone.
    """
    return docs.withColumn("language", scorer(model, ambiguous)(F.col("text"), F.coalesce(F.col("text").rlike(LETTER), F.lit(False))))


def crc_fold(key: str, n: int) -> int:
    return zlib.crc32(key.encode()) % n
