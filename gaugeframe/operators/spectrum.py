"""Leading directions of unit rows under stratified weights, by block subspace iteration.

The second moment of the weighted unit rows of a fold's training side is never formed when vectors are long: a block of
orthonormal directions is multiplied with it by one pass over the rows, in partial sums of the size of the block, for
all folds at once. The block is turned to the moment's own axes after each pass (a Rayleigh quotient), and what that
leaves over, the residual, tells when to stop. The block is as wide as the vectors where that is small, so that one pass
is exact; else it starts at ``BLOCK`` directions and doubles until they hold the energy asked for with some to spare.

Rows may be any number; the driver and each task hold the block, at most ``MOST`` numbers a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.tables import cut

# The least squared norm of a row with a direction, the least eigenvalue that counts as stable against the
# first one, and how near an eigenvalue must be to the last one kept to be kept with it.
ZERO, STABLE, TIE = 1e-24, 1e-7, 1e-6
#: Directions of a first block, numbers of a block at most (64 MB), passes for a block at most, and the residual, against
#: the first eigenvalue, at which a direction counts as found.
BLOCK, MOST, PASSES, RESIDUAL = 256, 1 << 23, 200, 1e-9
#: A block is widened if the directions that hold the energy take more of it than this.
SPARE = 0.75
#: Rows that are multiplied at once.
ROWS = 2048


@dataclass
class Directions:
    """Of one fold: the directions as columns, their eigenvalues, the share of the energy that they hold."""

    basis: np.ndarray
    values: np.ndarray
    captured: float

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Rows in the space of the directions, as unit vectors."""
        at = x @ self.basis
        size = np.linalg.norm(at, axis=1, keepdims=True)
        if not (size > 1e-12).all():
            raise ValueError("a projection without a direction")
        return at / size


def kept_directions(values: np.ndarray, whole: float, energy: float) -> int | None:
    """How many of the eigenvalues, falling, hold ``energy`` of ``whole``, with those that tie with the last of them;
    None if they don't hold it, or the last one might tie with one that isn't there."""
    stable = values[values > STABLE * values[0]]
    reached = np.flatnonzero(np.cumsum(stable) >= energy * whole * (1 - 1e-14))
    if not len(reached):
        return None
    last = stable[reached[0]]
    return int((stable >= last - max(TIE * last, 10 * np.finfo(float).eps * stable[0])).sum())


def stratified(df: DataFrame, vector: str, fold: str, strata: list[str], folds: int) -> tuple[DataFrame, np.ndarray]:
    """(rows with their unit vector ``_u``, stratum number ``_s`` and fold ``_f``), and the weight of a row by held-out
    fold and stratum: every stratum of a training side weighs alike, and so does every row in it."""
    size = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = df.withColumn("_q", size).withColumn("_f", F.col(fold).cast("int"))
    named = F.to_json(F.struct(*strata))
    counts = rows.groupBy(named.alias("_name"), "_f").agg(F.count("*").alias("n"), F.min("_q").alias("least"), F.bool_and(F.coalesce(F.col("_q") < float("inf"), F.lit(False)) & ~F.isnan("_q")).alias("finite"), F.min(F.size(vector)).alias("short"), F.max(F.size(vector)).alias("long"))
    found = counts.collect()  # a row a stratum and fold
    if not found:
        raise ValueError("no rows")
    if not all(r["finite"] for r in found) or len({x for r in found for x in (r["short"], r["long"])}) > 1:
        raise ValueError("vectors must be finite and of one length")
    if min(r["least"] for r in found) <= ZERO:
        raise ValueError("a zero vector has no direction")
    names = sorted({r["_name"] for r in found})
    place = {k: i for i, k in enumerate(names)}
    n = np.zeros((folds, len(names)))
    for r in found:
        for f in range(folds):
            n[f, place[r["_name"]]] += r["n"] * (r["_f"] != f)
    if not (n > 0).all():
        raise ValueError(f"the training rows of fold {int(np.argwhere(n == 0)[0][0])} lack a stratum")
    numbers = df.sparkSession.createDataFrame(list(place.items()), "_name string, _s int")
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.sqrt("_q"))
    rows = rows.withColumn("_name", named).join(F.broadcast(numbers) if len(names) < 10_000 else numbers, "_name").withColumn("_u", unit).drop("_q", "_name")
    return cut(rows), 1 / (len(names) * n)


def _summed(rows: DataFrame, weights: np.ndarray, part: Callable[[int, np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """For each fold the sum of ``part`` (fold, training rows, their weights) over all training rows: partial sums by
    task, added by pieces of a row of the result."""
    folds = len(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, *shape))
        for b in batches:
            for i in range(0, len(b), ROWS):
                some = b.iloc[i : i + ROWS]
                x, s, own = np.stack(some["_u"].to_numpy()), some["_s"].to_numpy(), some["_f"].to_numpy()
                for f in range(folds):
                    train = own != f
                    if train.any():
                        total[f] += part(f, x[train], weights[f, s[train]])
        for f in range(folds):
            yield pd.DataFrame({"f": f, "r": np.arange(shape[0]), "x": list(total[f])})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[:1].assign(x=[np.sum(np.stack(g["x"].to_numpy()), axis=0)])

    schema = "f int, r int, x array<double>"
    sums = rows.select("_u", "_s", "_f").mapInPandas(run, schema).groupBy("f", "r").applyInPandas(add, schema).collect()
    out = np.zeros((folds, *shape))
    for r in sums:
        out[r["f"], r["r"]] = r["x"]
    return out


def leading(rows: DataFrame, weights: np.ndarray, energy: float = 0.99, block: int = BLOCK) -> list[Directions]:
    """The directions of every held-out fold, from ``stratified`` rows. The whole energy is 1, as weights sum to 1."""
    if not 0 < energy <= 1:
        raise ValueError("the energy must be in (0, 1]")
    folds, d = len(weights), int(rows.select(F.max(F.size("_u"))).first()[0])
    rng = np.random.default_rng(0)
    width, done = min(d, block), [None] * folds
    q = np.broadcast_to(np.eye(d)[:, :width], (folds, d, width)) if width == d else np.stack([np.linalg.qr(rng.standard_normal((d, width)))[0]] * folds)
    while True:
        if d * width > MOST:
            raise ValueError(f"directions of {d} coordinates that hold {energy} of the energy take more than {MOST} numbers; vectors.narrowed shortens those of a small pool")
        for turn in range(PASSES):
            y = _summed(rows, weights, lambda f, x, w, q=q: x.T @ (w[:, None] * (x @ q[f])), (d, width))
            narrow = False
            for f in range(folds):
                values, axes = np.linalg.eigh((q[f].T @ y[f] + y[f].T @ q[f]) / 2)
                values, axes = values[::-1], axes[:, ::-1]
                basis, image = q[f] @ axes, y[f] @ axes
                left = np.linalg.norm(image - basis * values, axis=0)
                k = kept_directions(values, 1.0, energy)
                sure = k is not None and (width == d or k < width) and (left[: k + 1] <= RESIDUAL * values[0]).all()
                done[f] = Directions(basis[:, :k], values[:k], float(values[:k].sum())) if sure else None
                # The fewer directions are to spare, the slower those that count are found.
                narrow |= not sure and (k is None or k > SPARE * width)
            if all(done):
                return done
            if width == d:
                raise ValueError("the spectrum can't hold the energy asked for")
            if narrow and turn >= 2:
                break
            q = np.stack([np.linalg.qr(y[f])[0] for f in range(folds)])
        wider = min(d, 2 * width)
        if wider == d:
            q = np.broadcast_to(np.eye(d), (folds, d, d))
        else:
            q = np.stack([np.linalg.qr(np.hstack([q[f], rng.standard_normal((d, wider - width))]))[0] for f in range(folds)])
        width = wider


def spread(rows: DataFrame, weights: np.ndarray, found: list[Directions]) -> list[float]:
    """The effective dimension of each fold: 1 over the mean squared cosine of two weighted draws of projected rows."""
    k = max(f.basis.shape[1] for f in found)

    def part(f: int, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        c, out = found[f].coordinates(x), np.zeros((k, k))
        out[: c.shape[1], : c.shape[1]] = c.T @ (w[:, None] * c)
        return out

    return [float(1 / (m * m).sum()) for m in _summed(rows, weights, part, (k, k))]


def pca_by_fold(df: DataFrame, vector: str, fold: str, strata: list[str], folds: int, energy: float = 0.99, block: int = BLOCK) -> DataFrame:
    """V3: of each held-out fold, the fit over all other folds: a row a fold."""
    rows, weights = stratified(df, vector, fold, strata, folds)
    found = leading(rows, weights, energy, block)
    d_eff = spread(rows, weights, found)
    counts = {r["_f"]: r["count"] for r in rows.groupBy("_f").count().collect()}
    lines = [(f, sum(n for o, n in counts.items() if o != f), len(x.values), x.captured, d_eff[f], float(x.values[0])) for f, x in enumerate(found)]
    return df.sparkSession.createDataFrame(lines, "held_out int, rows long, k long, captured double, d_eff double, first_value double")


def projected_pairs(df: DataFrame, vector: str, fold: str, strata: list[str], folds: int, pair: str, side: str, energy: float = 0.99, block: int = BLOCK) -> DataFrame:
    """Of each pair in the fold that holds it out, the cosine in that fold's directions, the same times the
    root of the effective dimension, and the raw cosine. Rows are projected where they lie; a pair meets in a shuffle of
    coordinates. Pairs with another number of sides than two are left out."""
    rows, weights = stratified(df, vector, fold, strata, folds)
    found = leading(rows, weights, energy, block)
    d_eff = spread(rows, weights, found)
    kind = dict(rows.dtypes)[pair]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), ROWS):
                some = b.iloc[i : i + ROWS]
                x, own = np.stack(some["_u"].to_numpy()), some["_f"].to_numpy()
                at = np.empty(len(some), object)
                for f in set(own.tolist()):
                    here = np.flatnonzero(own == f)
                    for j, c in zip(here, found[f].coordinates(x[here]), strict=True):
                        at[j] = c
                yield pd.DataFrame({"fold": own, "pair": some["_pair"], "side": some["_side"], "c": at, "u": some["_u"]})

    placed = rows.where((F.col("_f") >= 0) & (F.col("_f") < folds)).select("_u", "_f", F.col(pair).alias("_pair"), F.col(side).cast("string").alias("_side"))
    ends = placed.mapInPandas(run, f"fold int, pair {kind}, side string, c array<double>, u array<double>")
    both = ends.groupBy("fold", "pair").agg(F.count_distinct("side").alias("n"), F.min_by(F.struct("c", "u"), "side").alias("a"), F.max_by(F.struct("c", "u"), "side").alias("b")).where("n = 2")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    root = F.element_at(F.array(*[F.lit(v**0.5) for v in d_eff]), F.col("fold") + 1)
    cosine = dot(F.col("a.c"), F.col("b.c"))
    return both.select("fold", "pair", cosine.alias("cosine"), (cosine * root).alias("normalised"), dot(F.col("a.u"), F.col("b.u")).alias("raw"))


def fit_pca(x: np.ndarray, strata: list, energy: float = 0.99) -> dict:
    """V3 for rows at hand: k, values, captured, d_eff and the directions as columns."""
    _, at, n = np.unique(np.array(strata, dtype=str), return_inverse=True, return_counts=True)
    w, unit = 1 / (len(n) * n[at]), x / np.linalg.norm(x, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ (w[:, None] * unit))
    k = kept_directions(values[::-1], 1.0, energy)
    found = Directions(axes[:, ::-1][:, :k], values[::-1][:k], float(values[::-1][:k].sum()))
    m = (c := found.coordinates(unit)).T @ (w[:, None] * c)
    return {"k": k, "values": found.values, "captured": found.captured, "d_eff": float(1 / (m * m).sum()), "basis": found.basis}
