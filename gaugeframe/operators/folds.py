"""G1: folds by component. Rows that share an identity may never be split over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import rank_digest
from gaugeframe.operators.sampling import components, sliced_rank
from gaugeframe.operators.tables import cut
from gaugeframe.operators.validation import assert_empty


def component_folds(rows: DataFrame, task: str, source: str, identities: Column | None, folds: int, seed: object, locked: str | None = None, pool: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``component`` and ``fold``: rows of a source, and sources that share one of ``identities`` (an array,
    null or empty for rows that share none), are one component, and a component has one fold.

    ``pool`` is a reference that was split before: (identity, fold), where an identity is ``source:`` and a source or
    ``image:`` and an identity. It locks the components that hold one of its identities, as does a fold in ``locked``
    of any of their rows; identities that no row has lock nothing. Two locks that differ are an error. All other
    components get their rank modulo ``folds``, by the digest of their name among the components of their least task;
    a locked one takes a rank too. A component is named after its least identity.

    Locks are aggregated by component before anything is ranked, and the folds go back to the rows by a join on the
    source, so no component or task is ever held by one task. Rows without a source are components of their own source
    (null is one); a null task is the least of all.
    """
    names = F.array_compact(F.transform(F.coalesce(identities, F.array()), lambda x: F.concat(F.lit("image:"), x.cast("string")))) if identities is not None else F.array().cast("array<string>")
    own = rows.withColumn("_source", F.concat(F.lit("source:"), F.coalesce(F.col(source).cast("string"), F.lit("\0"))))
    edges = own.select("_source", F.explode(names).alias("_image")).distinct()
    roots = components(edges, "_source", "_image")
    # A source without shared identities is its own component; the table has a row a source, not a row a row.
    lock = F.col(locked).cast("int") if locked else F.lit(None).cast("int")
    sources = cut(own.groupBy("_source").agg(F.min(task).alias("_task"), F.bool_or(F.col(task).isNull()).alias("_bare"), F.min(lock).alias("_least"), F.max(lock).alias("_most")))
    placed = cut(sources.join(roots.withColumnRenamed("node", "_source"), "_source", "left").withColumn("component", F.coalesce("root", "_source")).drop("root"))
    locks = placed.select("component", "_least", "_most")
    if pool is not None:
        wanted = pool.select("identity", F.col("fold").cast("int").alias("_fold")).where("identity IS NOT NULL AND _fold IS NOT NULL")
        known = roots.select(F.col("node").alias("identity"), F.col("root").alias("component")).unionByName(placed.where("_source = component").select(F.col("_source").alias("identity"), "component")).distinct()
        locks = locks.unionByName(known.join(wanted, "identity").select("component", F.col("_fold").alias("_least"), F.col("_fold").alias("_most")))
    locks = cut(locks.groupBy("component").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most")))
    assert_empty(locks.where("_least <> _most"), "locked folds split a component")
    tasks = placed.groupBy("component").agg(F.when(~F.bool_or("_bare"), F.min("_task")).alias("_task"))
    ranked = tasks.join(locks.select("component", "_least"), "component").withColumn("_h", rank_digest(seed, F.col("component"))).withColumn("_piece", F.substring("_h", 1, 2))
    ranked = sliced_rank(ranked, ["_task"], "_piece", ["_h", "component"], "_rank").select("component", F.coalesce("_least", F.col("_rank") % folds).cast("int").alias("_own"))
    given = placed.select("_source", "component").join(ranked, "component")
    kept = [c for c in rows.columns if c not in ("component", "fold")]
    return own.select(*[F.col(f"`{c}`") for c in kept], "_source").join(given, "_source").select(*[F.col(f"`{c}`") for c in kept], "component", F.col("_own").alias("fold"))
