"""Digests and seeds that agree with other languages' SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_digest(seed: object, key: Column) -> Column:
    """H2: the hex digest of seed, a zero byte and the key; hex order is byte order."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), key.cast("string")), 256)


def stable_seed(seed: object, key: Column, modulus: int = 2**63 - 1) -> Column:
    """H1, H7: the first eight bytes of the digest of ``seed:key`` as a little-endian integer, modulo ``modulus``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    turned = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
    return (F.conv(turned, 16, 10).cast("decimal(20,0)") % F.lit(modulus).cast("decimal(20,0)")).cast("long")


def ordered_digest(order: Column, uid: Column) -> Column:
    """An aggregate, the digest of the uids in order, a newline after each. It holds a group's uids at once: for
    groups of bounded size. ``table_digest`` streams those of a whole table."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), uid.cast("string").alias("u"))))
    return F.sha2(F.concat(F.array_join(F.transform(rows, lambda r: r["u"]), "\n"), F.lit("\n")), 256)


def table_digest(df: DataFrame, order: str, uid: str) -> DataFrame:
    """H3: (count, ordered_uid_sha256) of a whole table. The digest is one chain by its definition, so one task reads the
    sorted uids, but it holds a batch of them only, and the sort spills."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, n = hashlib.sha256(), 0
        for b in batches:
            digest.update("".join(f"{u}\n" for u in b["uid"]).encode())
            n += len(b)
        yield pd.DataFrame({"count": [n], "ordered_uid_sha256": [digest.hexdigest()]})

    rows = df.select(F.col(order).alias("o"), F.col(uid).cast("string").alias("uid")).repartition(1).sortWithinPartitions("o", "uid")
    return rows.select("uid").mapInPandas(run, "count long, ordered_uid_sha256 string")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable isn't inlined again by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_hashes(values: Column, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` neighbours in an array, in order; none if it has fewer.

    Each value is hashed once, and a run's hash is taken of its values' hashes by place. Cutting out each run as an array
    would copy the whole array for every run.
    """
    last = F.size(values) - size
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
    return F.when(last >= 0, bound(F.transform(values, lambda x: F.xxhash64(x)), runs)).otherwise(F.array().cast("array<bigint>"))
