"""Periodic runs of words, after Kolpakov and Kucherov.

A run is a maximal stretch with a smallest period q and a length of at least ``exponent`` times q. The words of a text
are numbered, and

1. a suffix automaton cuts them into factors: each is the longest stretch that began before (it may overlap itself),
   or a word that is new;
2. Main's algorithm finds, at each start of a factor, the runs that cross or touch it. Such a run reaches less than its
   period beyond the factor before, so two factors bound its period, and Z-functions over them give all its extents;
3. a run that lies strictly inside a factor was found where the factor was copied from, and is copied with it.

All three take time in proportion to the words. Before, texts are cut at words that no run can hold: each stretch of
``exponent - 1`` words of a run is found again in that run, so words in no repeated stretch of that many separate the
text into parts that are searched alone. Nothing is lost by that, and most texts have no part left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Run = tuple[int, int, int]  # start, end, period


def factors(w: Sequence[int]) -> list[tuple[int, int]]:
    """(end, source) of each factor of ``w``; a source of -1 marks a new word.

    The automaton is built word by word. State i is that of the first i words, whose way on to state i + 1 needs no
    entry, as it is spelled by word i; all other ways lie in ``ways``. States beyond len(w) are clones. The suffix link
    of state i is the longest suffix of the first i words that ends earlier too: where it is shorter than the factor
    so far, the factor ends.
    """
    n = len(w)
    link, size, first = [0] * (n + 1), list(range(n + 1)), list(range(n + 1))
    link[0] = -1
    ways: dict[int, dict[int, int]] = {0: {}}
    out, start, source = [], 0, -1
    for i, c in enumerate(w):
        p = link[i]
        while p >= 0:
            # Only states before i are asked, so the unwritten way of p is there.
            q = p + 1 if p < i and w[p] == c else ways[p].get(c) if p in ways else None
            if q is not None:
                break
            ways.setdefault(p, {})[c] = i + 1
            p = link[p]
        if p < 0:
            link[i + 1] = 0
        elif size[q] == size[p] + 1:
            link[i + 1] = q
        else:
            clone = len(link)
            link.append(link[q])
            size.append(size[p] + 1)
            first.append(first[q])
            own = dict(ways.get(q, ()))
            if q < i:
                own[w[q]] = q + 1
            elif q == i:
                own[c] = i + 1
            ways[clone] = own
            link[q] = link[i + 1] = clone
            while p >= 0 and (p + 1 if p < i and w[p] == c else ways[p].get(c) if p in ways else None) == q:
                ways.setdefault(p, {})[c] = clone
                p = link[p]
        known = link[i + 1]
        if i + 1 - start > size[known]:
            if i > start:
                out.append((i, source))
            start, source = i, -1
            if size[known] < 1:
                out.append((i + 1, -1))
                start = i + 1
                continue
        source = first[known] - (i + 1 - start)
    if start < n:
        out.append((n, source))
    return out


def z_function(s: Sequence[int], until: int) -> list[int]:
    """For each place before ``until``, how far ``s`` from there agrees with its own start."""
    n = len(s)
    z = [n] + [0] * (until - 1)
    left = right = 0
    for i in range(1, until):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w: Sequence[int], before: int, at: int, end: int, exponent: int) -> Iterator[Run]:
    """The runs that cross or touch ``at`` and end in w[at:end], or at ``at``: Main's algorithm for the factors
    w[before:at] and w[at:end]. Periods ascend, so the first one of a stretch is its smallest.

    A run that crosses ``at`` starts after before - q, else the factor before and the next word would have occurred
    q words earlier and the factor would be longer. So its length is below (end - before) + q, and q below
    (end - before) / (exponent - 1).
    """
    most = (end - before - 1) // (exponent - 1)
    if most < 1:
        return
    low, n, none = max(0, before - most), len(w), [-1]

    def whole(i: int, j: int, q: int) -> bool:
        """Whether it goes on neither before the window nor after ``end``; one that does belongs to another place."""
        return j - i >= exponent * q and not (j == end < n and w[j] == w[j - q]) and not (i == low > 0 and w[i - 1] == w[i - 1 + q])

    right, left = w[at:end], w[low:at][::-1]
    over, back = min(most, len(right)), min(most, len(left))
    # Of a period that lies right of ``at`` (its start agrees with ``at``) and left of it (its end agrees).
    z_left = z_function([*left, *none, *right[:over][::-1], *left], len(left) + 1 + over)
    z_right = z_function([*right, *none, *w[at - back : at], *right], len(right) + 1 + back)
    for q in range(1, most + 1):
        if q <= over:
            i, j = at - z_left[len(left) + 1 + over - q], at + q + (z_right[q] if q < len(right) else 0)
            if whole(i, j, q):
                yield i, j, q
        if q <= back:
            i, j = at - q - (z_left[q] if q < len(left) else 0), at + min(z_right[len(right) + 1 + back - q], len(right))
            if whole(i, j, q):
                yield i, j, q


def runs_of(w: Sequence[int], exponent: int = 2, shortest: int = 2) -> list[Run]:
    """All runs of ``w`` with a length of at least ``exponent`` periods and ``shortest`` words, by start and period."""
    n = len(w)
    found: dict[int, dict[int, int]] = {}  # start: {end: period}
    start = before = 0
    for end, source in [*factors(w), (n, -1)]:
        for i, j, q in crossing(w, before, start, end, exponent) if start else ():
            found.setdefault(i, {}).setdefault(j, q)
        if source >= 0 and found:
            shift = start - source
            for i in range(source + 1, source + end - start):
                for j, q in list(found[i].items()) if i in found else ():
                    if j < source + end - start:
                        found.setdefault(i + shift, {}).setdefault(j + shift, q)
        before, start = start, end
    return sorted(((i, j, q) for i, ends in found.items() for j, q in ends.items() if j - i >= shortest), key=lambda r: (r[0], r[2]))


def parts(w: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int]]:
    """The stretches of ``w`` that can hold runs: in a run of at least e periods, each e - 1 words in a row come again in
    the run, so words outside all repeated stretches of that many are in no run. Cut again inside what is left, where a
    stretch must come again in the same part, for as long as at least half goes: n log n in all."""
    k, n = exponent - 1, len(w)
    if n < max(shortest, exponent):
        return []
    gram = w[: n - k + 1].astype(np.int64)
    for d in range(1, k):
        gram = np.unique(gram * (int(w.max()) + 1) + w[d : n - k + 1 + d], return_inverse=True)[1]
    bounds, left = [(0, n)], n
    while True:
        starts = np.array([b[0] for b in bounds])
        sizes = np.array([b[1] - b[0] - k + 1 for b in bounds])
        of = np.repeat(np.arange(len(bounds)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, back, count = np.unique(of * (n + 1) + gram[at], return_inverse=True, return_counts=True)
        again = count[back] > 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + k, -1)
        inside = np.concatenate([[False], np.cumsum(edge)[:n] > 0, [False]])
        # Grams of different parts don't chain: parts are at least one word apart already.
        ends = np.nonzero(inside[1:] != inside[:-1])[0].reshape(-1, 2)
        bounds = [(int(a), int(b)) for a, b in ends if b - a >= max(shortest, exponent)]
        rest = sum(b - a for a, b in bounds)
        if not bounds or rest * 2 > left:
            return bounds
        left = rest


def runs_of_words(ws: Sequence[bytes], exponent: int = 4, shortest: int = 6) -> list[Run]:
    """``runs_of`` over words, part by part."""
    places: dict[bytes, int] = {}
    w = np.fromiter((places.setdefault(x, len(places)) for x in ws), np.int64, len(ws))
    return [(i + a, j + a, q) for a, b in parts(w, exponent, shortest) for i, j, q in runs_of(w[a:b].tolist(), exponent, shortest)]


def kept_words(ws: Sequence[bytes], runs: Sequence[Run]) -> Sequence[bytes]:
    """The words outside all runs, and of each run its first period: where runs overlap, what any of them drops goes."""
    if not runs:
        return ws
    edge = np.zeros(len(ws) + 1, np.int64)
    for i, j, q in runs:
        edge[i + q] += 1
        edge[j] -= 1
    keep = np.cumsum(edge)[: len(ws)] == 0
    return [x for x, k in zip(ws, keep.tolist(), strict=True) if k]


SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(df: DataFrame, text: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """``df`` with a struct column ``periodic``: n_words, the runs of words by start and period, and the text with each
    run cut to its first period (words joined by one space).

    Runs have a length of at least ``exponent`` periods (2 or more) and ``shortest`` words. Words are ``WORD`` of the
    whole text. Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text; repeated
    rows get the same answer; an empty table stays empty; an existing column ``periodic`` is replaced, others are left
    alone. Time and memory grow with the words of a text, and each text is searched where it lies: nothing is shuffled.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            ws = (t or "").encode().split()  # ASCII white space: that of WORD
            runs = runs_of_words(ws, exponent, shortest)
            out.append((len(ws), [{"start": i, "length": j - i, "period": q} for i, j, q in runs], b" ".join(kept_words(ws, runs)).decode()))
        return pd.DataFrame(out, columns=["n_words", "runs", "collapsed"])

    return df.withColumn("periodic", run(F.col(text)))
