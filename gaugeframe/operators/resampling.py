"""Sums over many draws without a row for each row and draw: matrices of rows by draws, multiplied where the rows lie."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that become a matrix at once, and numbers of sums that a task holds before it hands them on (8 bytes each).
ROWS, HELD = 256, 1 << 22
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The places of a Poisson variable of mean 1 between 0 and 1; nine and more are taken as nine.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _end(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + P5 + np.uint64(8)) ^ (_turn(x * P2, 31) * P1)
    return _end(_turn(h, 27) * P1 + P4)


def _int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + P5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * P1)
    return _end(_turn(h, 23) * P2 + P3)


def hash_matrix(ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """What ``F.xxhash64(id, draw, seed)`` is for long ids and int draws and seed, unsigned: a row for each id."""
    own = _long(ids.view(np.uint64), np.full(len(ids), 42, np.uint64))
    drawn = _int(draws.astype(np.int64).view(np.uint64)[None, :], own[:, None])
    return _int(np.array([[seed]], np.int64).view(np.uint64), drawn)


def poisson(hashes: np.ndarray) -> np.ndarray:
    """How often a resample takes a row: a Poisson count of mean 1 from the low 40 bits."""
    return np.searchsorted(POISSON, (hashes & np.uint64((1 << 40) - 1)) / float(1 << 40), side="right").astype(np.float64)


def signs(hashes: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * (hashes & np.uint64(1)).astype(np.float64)


def sums_by_draw(df: DataFrame, group: Column, value: Column, row: Column, draws: int, seed: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(group, draw, weight, total): for each group and draw the sum of the weights of its rows and of weight times value.

    ``row`` is a long that tells rows apart; ``weigh`` makes weights of ``hash_matrix``. What leaves a task is a row for
    each group and draw that it has met, whatever its number of rows; a task with very many groups hands sums on in parts,
    so it holds ``HELD`` numbers and no more. Rows without a value are left out; a null group is one of its own; no
    rows give no sums.
    """
    rows = df.select(group.cast("string").alias("group"), value.cast("double").alias("value"), row.cast("long").alias("row")).where("value IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        every = np.arange(draws)

        def hand_on() -> Iterator[pa.RecordBatch]:
            for name, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(every, pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["group", "draw", "weight", "total"])
            held.clear()

        for b in batches:
            names, values, ids = b.column("group"), b.column("value").to_numpy(), b.column("row").to_numpy()
            for at in range(0, len(values), ROWS):
                codes, own = pd.factorize(np.array(names[at : at + ROWS].to_pylist(), object), use_na_sentinel=False)
                weights = weigh(hash_matrix(ids[at : at + ROWS], every, seed))
                for code, name in enumerate(own.tolist()):
                    name = name if isinstance(name, str) else None
                    of = codes == code
                    sums = held.setdefault(name, np.zeros((2, draws)))
                    sums[0] += weights[of].sum(0)
                    sums[1] += values[at : at + ROWS][of] @ weights[of]
                if 2 * draws * len(held) > HELD:
                    yield from hand_on()
        yield from hand_on()

    parts = rows.mapInArrow(run, "group string, draw int, weight double, total double")
    return parts.groupBy("group", "draw").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
