"""What the operators share: bounded samples, words, and the fixed hold-out hash.

Arrow batches are left at Spark's own bounds (10,000 rows or 64 MB, whichever comes first); the functions that make
large arrays of a batch go through it in slices. No operator changes a setting of the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.tables import cut, scratch

__all__ = ["SPACE", "WORD", "bounded", "cut", "fold", "hash_below", "labelled", "one_a_key", "scratch", "slices", "table", "words"]

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that are turned into arrays at once.
SLICE = 256


def slices(n: int, size: int = SLICE) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, repeats included; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``: the hold-out hash. A null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0)).cast("int")


def hash_below(h: Column, share: Column | float) -> Column:
    """Whether a signed 64-bit hash lies in the lowest ``share`` of all values."""
    return h.cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * share


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """``docs`` joined with their one label where crc32(doc_id) mod ``folds`` isn't ``held``.

    Null labels and ids are left out. If labels contradict each other for an id, the larger one holds.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = one.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    one = one.where(fold(F.col("doc_id"), folds) != held)
    return docs.join(one, "doc_id")


def bounded(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``by``: the same ones on every run. Hashes are uniform, so a task
    passes on its share of a little more than that and no more. ``df`` is written first, as it is counted and read."""
    df, h = cut(df), F.xxhash64(*by)
    return df.where(hash_below(h, min(1.0, (1.5 * rows + 64) / max(df.count(), 1)))).orderBy(h, *by).limit(rows)


def one_a_key(df: DataFrame, *key: str) -> DataFrame:
    """One row a key, the first by a hash of the row: an aggregate, so a key with any number of rows is thinned where
    they are."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")).select(*key, "_row.*")
