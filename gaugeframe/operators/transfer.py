"""The transfer cube: accuracy and gain by scope, node, model and seed, with exact paired tests.

Facts are one row a (model, seed, question): uid, benchmark, family, capability, model, seed, hit. They are summed
once to (benchmark, family, capability, model, seed); scopes and nodes are roll-ups of that small table, so the facts
are shuffled as partial sums only.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.stats import exact_test, sem

ALL = "ALL"


def scopes_and_nodes(df: DataFrame) -> DataFrame:
    """Each row once for each scope (ALL, its benchmark) and node (overall, its family, its capability)."""
    node = lambda kind, name: F.struct(F.lit(kind).alias("level"), name.alias("node"))
    nodes = F.array(node("overall", F.lit("overall")), node("family", F.col("family")), node("capability", F.col("capability")))
    return df.withColumn("scope", F.explode(F.array(F.lit(ALL), F.col("benchmark")))).withColumn("n", F.explode(nodes)).select("*", "n.level", "n.node").drop("n")


def per_seed(facts: DataFrame, baseline: str, benchmarks: list[str] | None = None) -> DataFrame:
    """A1: scope, level, node, model, seed, correct, total, accuracy and gain (percentage points over the same seed's
    baseline). The grid is dense: a scope has every node; a cell without questions has null measures. A cell with an
    accuracy whose seed the baseline lacks fails the query when it is read."""
    base = facts.groupBy("benchmark", "family", "capability", "model", "seed").agg(F.sum("hit").alias("correct"), F.count("hit").alias("total"))
    cells = scopes_and_nodes(base).groupBy("scope", "level", "node", "model", "seed").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    runs = cells.select("model", "seed").distinct()
    scopes = cells.select("scope").distinct()
    if benchmarks is not None:
        named = facts.sparkSession.createDataFrame([(b,) for b in [ALL, *benchmarks]], "scope string")
        scopes = scopes.unionByName(named).distinct()
    grid = scopes.join(F.broadcast(cells.select("level", "node").distinct())).join(F.broadcast(runs))  # dimensions only
    dense = grid.join(cells, ["scope", "level", "node", "model", "seed"], "left")
    dense = dense.withColumn("accuracy", F.try_divide(100.0 * F.col("correct"), F.col("total").cast("double")))
    first = F.max(F.when(F.col("model") == baseline, F.col("accuracy")))
    against = dense.groupBy("scope", "level", "node", "seed").agg(first.alias("base"))
    return dense.join(against, ["scope", "level", "node", "seed"]).withColumn("gain", F.col("accuracy") - _paired("base")).drop("base")


def _paired(base: str) -> Column:
    lacks = F.concat(F.lit("the baseline has no run with seed "), F.col("seed").cast("string"))
    return F.when(F.col("accuracy").isNull() | F.col(base).isNotNull(), F.col(base)).otherwise(F.raise_error(lacks).cast("double"))


def summary(cells: DataFrame) -> DataFrame:
    """A2: mean, sample deviation and standard error of accuracy and of the per-seed gains."""
    stats = [f.alias(f"{c}_{k}") for c in ("accuracy", "gain") for k, f in (("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("sem", sem(F.col(c))))]
    return cells.groupBy("scope", "level", "node", "model").agg(F.count("accuracy").alias("seeds"), *stats)


MOST_PAIRED_SEEDS = 3


def runs_of(facts: DataFrame, baseline: str, paired: bool = True) -> dict[str, list[int]]:
    """The seeds of each model. They must be whole, not negative and the baseline's own, and at most three for
    exact tests. A row a run reaches the driver."""
    found: dict[str, list] = {}
    for r in facts.select("model", "seed").distinct().collect():
        found.setdefault(r["model"], []).append(r["seed"])
    if baseline not in found:
        raise ValueError(f"no run of {baseline}")
    for model, seeds in found.items():
        if any(not isinstance(s, int) or s < 0 for s in seeds):
            raise ValueError(f"seeds of {model} must be whole and not negative: {seeds}")
        if set(seeds) != set(found[baseline]):
            raise ValueError(f"{model} has the seeds {sorted(seeds)}, {baseline} has {sorted(found[baseline])}")
    if paired and len(found[baseline]) > MOST_PAIRED_SEEDS:
        raise ValueError(f"exact paired tests take 1 to {MOST_PAIRED_SEEDS} seeds, not {len(found[baseline])}")
    return found


def question_differences(facts: DataFrame, baseline: str, models: list[str], seeds: list[int]) -> DataFrame:
    """benchmark, family, capability, model and d, the seed-summed difference to the baseline, of every question and model.

    A question's facts are summed where they are, a column a model, before they are shuffled. Beside the hits each column
    counts every seed in bits of its own, so that a missing or repeated run shows.
    """
    key = ["uid", "benchmark", "family", "capability"]
    place = functools.reduce(lambda c, i: c.when(F.col("seed") == seeds[i], F.lit(1 << 20 * i)), range(1, len(seeds)), F.when(F.col("seed") == seeds[0], F.lit(1)))
    whole = sum(1 << 20 * i for i in range(len(seeds)))
    own = lambda m, c: F.sum(F.when((F.col("model") == m) & F.col("hit").isNotNull(), c.cast("long")))
    sums = {m: (f"h{i}", f"s{i}") for i, m in enumerate([baseline, *models])}
    each = facts.groupBy(*key).agg(*[x for m, (h, n) in sums.items() for x in (own(m, F.col("hit")).alias(h), own(m, place).alias(n))])
    full = functools.reduce(Column.__and__, [F.coalesce(F.col(n) == whole, F.lit(False)) for _, n in sums.values()])
    lacks = F.concat(F.lit("a run is missing or repeated for question "), F.col("uid").cast("string"))
    base = F.when(full, F.col("h0")).otherwise(F.raise_error(lacks).cast("long"))
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(sums[m][0]) - F.col("base")).alias("d")) for m in models])
    return each.withColumn("base", base).select(*key[1:], F.explode(pairs).alias("p")).select(*key[1:], "p.model", "p.d")


#: Models that are compared with the baseline in one pass over the facts.
AT_ONCE = 32


def difference_counts(facts: DataFrame, baseline: str) -> DataFrame:
    """A4: of each (scope, node, model): questions whose seed-summed difference to the baseline is 1, 2 or 3 in size,
    and the sum of differences. Seeds cancel within a question before anything is counted.

    Every model must answer every question once with every seed: a question that doesn't fails the query when it is
    read.
    """
    runs = runs_of(facts, baseline)
    models, seeds = sorted(m for m in runs if m != baseline), sorted(runs[baseline])
    parts = [question_differences(facts, baseline, models[i : i + AT_ONCE], seeds) for i in range(0, max(len(models), 1), AT_ONCE) if models]
    if not parts:
        raise ValueError(f"no model but {baseline}")
    d = functools.reduce(DataFrame.unionByName, parts)
    counts = [F.sum((F.abs("d") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3)]
    small = d.groupBy("benchmark", "family", "capability", "model").agg(*counts, F.sum("d").alias("difference"), F.count("*").alias("questions"))
    sums = [F.sum(c).alias(c) for c in ("n1", "n2", "n3", "difference", "questions")]
    return scopes_and_nodes(small).groupBy("scope", "level", "node", "model").agg(*sums)


#: Tasks that the exact tests are dealt over: their time grows with the square of the number of questions.
TEST_TASKS = 64


def paired_tests(counts: DataFrame) -> DataFrame:
    """``difference_counts`` with the exact test. The test runs once for each distinct set of counts."""
    seen = counts.select("n1", "n2", "n3", F.abs("difference").alias("size")).distinct().repartition(TEST_TASKS, "n1", "n2", "n3", "size")
    tested = seen.withColumn("t", exact_test("n1", "n2", "n3", "size")).select("n1", "n2", "n3", "size", "t.*")
    return counts.withColumn("size", F.abs("difference")).join(tested, ["n1", "n2", "n3", "size"]).drop("size")


def matrix(cells: DataFrame, tests: DataFrame, baseline: str) -> DataFrame:
    """A3: a row for each model but the baseline and each capability over all benchmarks, with significance."""
    rows = summary(cells).where((F.col("scope") == ALL) & (F.col("level") == "capability") & (F.col("model") != baseline))
    return rows.join(tests.select("scope", "level", "node", "model", "p", "significant"), ["scope", "level", "node", "model"], "left")


def order_of(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]
