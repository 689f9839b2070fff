"""Semi and anti joins that move no row which a Bloom filter can decide.

The filter is a bitmap of at most ``MOST_BITS`` bits, 8 MB, whatever the number of keys: partial ``bit_or`` aggregates
make its words, and it is broadcast as one row. A row whose key misses the filter isn't among the keys and stays where
it is; one that hits may be, and is confirmed by an ordinary join. So with more keys than the filter holds well, more
rows are confirmed and the result is the same.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.tables import cut

#: Bits of a filter at least and at most, bits a key, places a key, and 64-bit words that make a row of the bitmap.
LEAST_BITS, MOST_BITS, BITS_A_KEY, PLACES, ROW = 1 << 16, 1 << 26, 12, 4, 1024


def bits_for(keys: int) -> int:
    """A power of two of bits for so many keys, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_A_KEY * keys - 1).bit_length()))


def places(key: list[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(bits)) for seed in range(PLACES)]


def bloom_filter(keys: DataFrame, key: list[str], bits: int) -> DataFrame:
    """One row, ``_filter``: the bitmap of ``keys`` as rows of ``ROW`` words. Words are or-ed where the keys lie, then
    by word; no more than the bitmap is ever gathered."""
    at = keys.select(F.explode(F.array(*places([F.col(k) for k in key], bits))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("set"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    rows = every.join(words, "word", "left").groupBy(F.floor(F.col("word") / ROW).alias("row")).agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0)).alias("set")))).alias("w"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("row", F.col("w.set").alias("w")))).alias("f")).select(F.col("f.w").alias("_filter"))


def _maybe(key: list[Column], bits: int) -> Column:
    """Whether all places of a key are set; false for a key with a null, which equals none."""
    word = lambda at: F.element_at(F.element_at("_filter", (F.floor(at / (64 * ROW)) + 1).cast("int")), (F.floor(at / 64) % ROW + 1).cast("int"))
    hits = [F.getbit(word(at), (at % 64).cast("int")) == 1 for at in places(key, bits)]
    return functools.reduce(Column.__and__, [*(k.isNotNull() for k in key), *hits])


def _parts(left: DataFrame, right: DataFrame, key: list[str], bits: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ``left`` that may match, rows that don't, the distinct keys under names of their own)."""
    names = [f"_bloom_{i}" for i in range(len(key))]
    types = dict(left.dtypes)
    # Both sides are hashed as the left side's type, so equal keys hash alike.
    keys = right.select(*[F.col(f"`{k}`").cast(types[k]).alias(n) for k, n in zip(key, names, strict=True)]).na.drop().distinct()
    keys = cut(keys)
    bits = bits or bits_for(keys.count())
    row = F.broadcast(cut(bloom_filter(keys, names, bits)))
    maybe = _maybe([F.col(f"`{k}`") for k in key], bits)
    return left.join(row, maybe, "left_semi"), left.join(row, maybe, "left_anti"), keys


def _matches(key: list[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(f"`{k}`") == F.col(f"_bloom_{i}") for i, k in enumerate(key)])


def filtered_semi(left: DataFrame, right: DataFrame, key: list[str], bits: int | None = None) -> DataFrame:
    """The rows of ``left`` whose key is among those of ``right``, as often as they come; null keys match nothing. Only
    rows that hit the filter are shuffled; ``left`` is read once."""
    hit, _, keys = _parts(left, right, key, bits)
    return hit.join(keys, _matches(key), "left_semi")


def filtered_anti(left: DataFrame, right: DataFrame, key: list[str], bits: int | None = None) -> DataFrame:
    """The rows of ``left`` whose key isn't among those of ``right``, with null keys. Rows that miss the filter pass
    unshuffled; ``left`` is read twice, once for them and once for those that are confirmed."""
    hit, miss, keys = _parts(left, right, key, bits)
    return miss.unionByName(hit.join(keys, _matches(key), "left_anti"))
