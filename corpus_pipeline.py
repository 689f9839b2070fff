"""From raw documents to a training mix, in five stages; each calls one operator of gaugeframe.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. The first four return the columns of ``documents`` as they came, of the rows that they keep; the last
returns the mix. Names of columns that a stage adds for itself start with ``_stage_`` and don't leave it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import decontaminate, gam, langid, mixing, simhash
from gaugeframe.llm.common import cut, table

#: A flagged document is rejected only if its two nearest languages are as good as even.
AMBIGUOUS = 0.01
#: The least quality score of a document that stays.
QUALITY = 0.3


#: Rows up to which a list of ids or keys is broadcast (8 bytes each, a key about 80); a longer list is joined by shuffle.
MOST_IDS = 2_000_000


def _listed(rows: DataFrame) -> DataFrame:
    rows = cut(rows.distinct())
    return F.broadcast(rows) if rows.count() <= MOST_IDS else rows


def without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` but for the rows whose doc_id is in ``ids``. Texts are moved only if the list is too long to broadcast."""
    ids = _listed(ids.select(F.col("doc_id").alias("_stage_id")))
    return docs.join(ids, F.col("doc_id") == F.col("_stage_id"), how)


def without_keys(docs: DataFrame, of: Column, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` but for the rows whose doc_id, which may be null, and value of ``of`` are a row of ``keys``: (doc_id, key)."""
    keys = _listed(keys.select(F.col("doc_id").alias("_stage_id"), F.col("key").alias("_stage_key")))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_stage_id")) & (of == F.col("_stage_key")), how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those without a letter (``und``) and those between two languages go.

    So null and empty texts go; long texts are judged whole; rows that repeat each other are judged alike, ids may be
    null, and an empty table stays empty. Where no row names a language, none can be told and all go.
    """
    found = docs.withColumn("_stage_language", langid.scorer(langid.train(docs), AMBIGUOUS)(F.col("text"), F.coalesce(F.col("text").rlike(langid.LETTER), F.lit(False))))
    kept = (F.col("_stage_language.lang_pred") != langid.UNKNOWN) & ~F.col("_stage_language.ambiguous")
    return found.where(kept).select(docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the additive model scores at ``QUALITY`` or more.

    Null and empty texts get the score of all-zero features; long texts are measured whole; rows that repeat each other
    are judged alike, ids may be null, and an empty table stays empty. Without any label all stay.
    """
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_stage_score", gam.scorer(model)(F.col("text").cast("binary"))).where(F.col("_stage_score") >= QUALITY).select(docs.columns)


def survivors(keys: DataFrame) -> DataFrame:
    """(doc_id, fp) of the rows that stay, one for each root of ``keys``: (root, doc_id, fp). The smallest id of the
    root comes first, of its fingerprints the smallest; a row without an id comes last."""
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "fp")
    return keys.groupBy("root").agg(F.min(order).alias("head")).select("head.doc_id", "head.fp")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest doc_id.

    Groups are told apart by their root fingerprint and rows by doc_id and fingerprint, so an id that is dropped in
    one group stays in another, and an id on unrelated texts stays with each of them: every group keeps a row. Rows
    that share id and fingerprint are one document: the first by a hash of the row stays. A group without any id keeps
    one row in the same way. Null and empty texts are one group, long texts are hashed whole, and an empty table stays
    empty.
    """
    found = cut(simhash.near_duplicates(docs))  # so that rows of a hot fingerprint are joined in parts, and counted where they are
    keys = cut(found.groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n")))
    kept = survivors(keys).select(F.col("doc_id").alias("_stage_id"), F.col("fp").alias("_stage_fp"))
    same = F.col("doc_id").eqNullSafe(F.col("_stage_id")) & (F.col("fp") == F.col("_stage_fp"))
    keys = cut(keys.join(kept, same, "left").select("doc_id", F.col("fp").alias("key"), "n", F.col("_stage_fp").isNotNull().alias("stays")))
    plain = F.col("stays") & (F.col("n") == 1)
    # Most ids stay or go as a whole. Fingerprints are made again only for ids that don't, and for rows without one.
    ids = keys.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(plain).alias("whole"), F.bool_or("stays").alias("some"))
    ids = cut(ids.where("NOT whole"))
    single = without(docs.where(F.col("doc_id").isNotNull()), ids.select("doc_id"))
    mixed = ids.where("some").select("doc_id")
    parts = [] if mixed.isEmpty() else [without(docs, mixed, "left_semi")]
    parts += [] if keys.where("doc_id IS NULL").isEmpty() else [docs.where(F.col("doc_id").isNull())]
    of = keys.join(mixed, "doc_id", "left_semi").unionByName(keys.where("doc_id IS NULL"))
    for part in parts:
        part = part.withColumn("_stage_print", _fingerprint()(F.col("text").cast("binary")))
        single = single.unionByName(without_keys(part, F.col("_stage_print"), of.where(~plain)).select(docs.columns))
        if not (several := of.where("stays AND n > 1")).isEmpty():
            rows = without_keys(part, F.col("_stage_print"), several, "left_semi")
            first = rows.groupBy("doc_id", "_stage_print").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_stage_row"))
            single = single.unionByName(first.select("_stage_row.*"))
    return single


def _fingerprint():
    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(list(simhash.many_fingerprints(text)), dtype="int64")

    return run


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of a benchmark item: rows go by their text, not by their id alone.

    Null and empty texts and items leak nothing; long texts are looked at whole; rows that repeat a leaking one go with
    it, whatever else shares their id or their lack of one stays; an empty table stays empty.
    """
    leaking = decontaminate.leaks_by_text(docs, table(spark, sf_dir, "benchmark"))
    return without_keys(docs, F.xxhash64("text"), leaking.select("doc_id", F.col("text_hash").alias("key")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, copies and taken of each document.

    A null or empty text takes nothing; a null source is one of its own; rows that repeat each other are rounded one by
    one; ids may be null; an empty table gives an empty mix.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

#: Trained models, graph components and random rounding: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
