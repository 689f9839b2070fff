"""Sinks: reports that never overwrite, manifests with their digest, files by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import table_digest
from gaugeframe.operators.validation import assert_empty, duplicates


def report(tables: dict[str, DataFrame], path: str) -> None:
    """K2, K3: each table as CSV below ``path``; an existing one is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")


def manifest(rows: DataFrame, path: str, ordinal: str = "ordinal") -> DataFrame:
    """K1: JSON lines in order, and a row of metadata beside them: count and digest of the ordered uids.

    The rows are range-partitioned by the ordinal, so files sorted by name hold them in order. Rows with the same
    ordinal are in the order of their uids, as in the digest.
    """
    assert_empty(duplicates(rows, ["uid"]), "repeated uid")
    rows.repartitionByRange(ordinal).sortWithinPartitions(ordinal, F.col("uid").cast("string")).write.mode("errorifexists").json(f"{path}/rows")
    meta = table_digest(rows, ordinal, "uid")
    meta.write.mode("errorifexists").json(f"{path}/metadata")
    return meta


def by_group(df: DataFrame, group: str, path: str, kind: str = "parquet") -> None:
    """K7: a folder for each group."""
    df.write.mode("errorifexists").partitionBy(group).format(kind).save(path)


def content_store(df: DataFrame, content: str) -> DataFrame:
    """K6: each distinct content once, with its place ``ab/abcd....``."""
    digest = F.sha2(content, 256)
    return df.select(F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("path"), F.col(content).alias("content")).dropDuplicates(["path"])


def parquet_to_tsv(df: DataFrame, path: str) -> None:
    """S16"""
    df.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


def derived_path(path: str, suffix: str, kind: str | None = None) -> str:
    """K9: ``a/b.xlsx`` with suffix ``_acc`` and kind ``csv`` is ``a/b_acc.csv``."""
    stem, _, own = path.rpartition(".")
    return f"{stem}{suffix}.{kind or own}"


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": lambda df, p: df.write.mode("errorifexists").option("header", True).csv(p),
    "tsv": parquet_to_tsv,
    "jsonl": lambda df, p: df.write.mode("errorifexists").json(p),
    "parquet": lambda df, p: df.write.mode("errorifexists").parquet(p),
}


def dump(df: DataFrame, path: str) -> None:
    """K5: by suffix. A suffix without a writer is an error: a pickle can't be read safely and holds one machine's rows."""
    suffix = path.rpartition(".")[2]
    if suffix not in WRITERS:
        raise ValueError(f"no writer for {path}")
    WRITERS[suffix](df, path)


def artifact(rows: DataFrame, vectors: DataFrame, path: str) -> None:
    """K8: the rows of a gradient artifact (uid, fold, loss, loss_tokens, ...) and its vectors (uid, name, values)."""
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    vectors.write.mode("errorifexists").parquet(f"{path}/vectors")


def localised(df: DataFrame, index: str, payload: str) -> DataFrame:
    """base64 payloads as contents with a place by their digest, and the rows that point there: (index, path, content).
    Spark writes tables, not loose files, so the store is a table of contents by place."""
    content = F.unbase64(F.col(payload))
    digest = F.sha2(content, 256)
    return df.select(index, F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("path"), content.alias("content"))
