"""Transfer analysis over the order facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.operators import transfer

from .facts import BASELINE, HITS, hits, rounded


def transfer_per_seed(spark, d):
    cells = transfer.per_seed(hits(spark, d), BASELINE)
    return rounded(cells.select("scope", "level", "node", "model", "seed", F.col("correct").cast("long").alias("correct"), F.col("total").cast("long").alias("total"), "accuracy", "gain"))


def transfer_summary(spark, d):
    return rounded(transfer.summary(transfer.per_seed(hits(spark, d), BASELINE)))


def paired_difference_counts(spark, d):
    return transfer.difference_counts(hits(spark, d), BASELINE)


def paired_exact_test(spark, d):
    return transfer.paired_tests(transfer.difference_counts(hits(spark, d), BASELINE))


def transfer_matrix(spark, d):
    facts = hits(spark, d)
    tests = transfer.paired_tests(transfer.difference_counts(facts, BASELINE).where("level = 'capability' AND scope = 'ALL'"))
    return rounded(transfer.matrix(transfer.per_seed(facts, BASELINE), tests, BASELINE))


def dense_grid_empty_cells(spark, d):
    """A benchmark without questions still has every node, with null measures."""
    cells = transfer.per_seed(hits(spark, d).where("benchmark <> '1-URGENT'"), BASELINE, benchmarks=["1-URGENT"])
    return rounded(cells.where("scope IN ('1-URGENT', 'ALL')").select("scope", "level", "node", "model", "seed", "accuracy", "gain"))


QUERIES = {f.__name__: f for f in (transfer_per_seed, transfer_summary, transfer_matrix, paired_difference_counts, paired_exact_test, dense_grid_empty_cells)}

_R = lambda cs: ", ".join(f"round({c}, 6) + 0.0 {c}" for c in cs)
#: How many sign choices reach the observed sum: the lower tail of i + 2j + 3k over binomials, by logarithms of gamma.
_TAIL = """k AS (SELECT level, node, model, CAST(n1 AS BIGINT) n1, CAST(n2 AS BIGINT) n2, CAST(n3 AS BIGINT) n3, abs(difference) o FROM counts WHERE scope = 'ALL' AND level = 'capability'),
b AS (SELECT n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) p FROM (SELECT DISTINCT unnest([n1, n2, n3]) n FROM k), LATERAL (SELECT unnest(range(0, n + 1)) i)),
w AS (SELECT level, node, model, o, (n1 + 2 * n2 + 3 * n3 - o) // 2 t, n1, n2, n3 FROM k),
d AS (SELECT level, node, model, o, t, n1, x.i + 2 * y.i + 3 * z.i s, sum(x.p * y.p * z.p) p FROM w JOIN b x ON x.n = n1 JOIN b y ON y.n = n2 JOIN b z ON z.n = n3 WHERE x.i + 2 * y.i + 3 * z.i <= t GROUP BY ALL),
v AS (SELECT level, node, model, CASE WHEN any_value(o) = 0 THEN 1 ELSE 2 * sum(p) END p FROM d GROUP BY ALL)"""
SQL = {
    "transfer_matrix": f"""WITH {HITS}, {_TAIL} SELECT scope, level, node, model, seeds, {_R([f'{c}_{k}' for c in ('accuracy', 'gain') for k in ('mean', 'std', 'sem')])}, round(p, 6) p, p < 0.05 significant
        FROM summaries JOIN v USING (level, node, model) WHERE scope = 'ALL' AND level = 'capability' AND model <> 'baseline'""",
    "transfer_per_seed": f"WITH {HITS} SELECT scope, level, node, model, seed, CAST(correct AS BIGINT) correct, total, {_R(['accuracy', 'gain'])} FROM per_seed",
    "transfer_summary": f"WITH {HITS} SELECT scope, level, node, model, seeds, {_R([f'{c}_{k}' for c in ('accuracy', 'gain') for k in ('mean', 'std', 'sem')])} FROM summaries",
    "paired_difference_counts": f"WITH {HITS} SELECT scope, level, node, model, CAST(n1 AS BIGINT) n1, CAST(n2 AS BIGINT) n2, CAST(n3 AS BIGINT) n3, difference, questions FROM counts",
    "dense_grid_empty_cells": f"""WITH {HITS.replace("FROM orders, runs)", "FROM orders, runs WHERE o_orderpriority <> '1-URGENT')")},
        grid AS (SELECT s.scope, n.level, n.node, r.model, r.seed FROM (VALUES ('ALL'), ('1-URGENT')) s(scope), (SELECT DISTINCT level, node FROM cells) n, runs r)
        SELECT scope, level, node, model, seed, {_R(['accuracy', 'gain'])} FROM grid LEFT JOIN per_seed USING (scope, level, node, model, seed)""",
}
