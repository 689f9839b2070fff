"""Benchmark reports: accuracy by levels, macro means, all-correct groups, confusion measures.

Every report starts from one partial aggregation over the rows; what follows works on a few groups.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import run_hashes
from gaugeframe.functions.stats import ratio, sem

OVERALL = "Overall"


def by_levels(df: DataFrame, hit: Column, split: str | None, levels: list[str]) -> DataFrame:
    """Mean hit of each split overall and by each level: split, level, name, n, accuracy.

    One grouping over all levels, then roll-ups of the small result (the same as grouping sets over the rows, with a
    smaller shuffle). A null name isn't a group.
    """
    key = [split] if split else []
    base = df.withColumn("_hit", hit.cast("double")).groupBy(*key, *levels).agg(F.sum("_hit").alias("_s"), F.count("_hit").alias("_n"))
    head = [F.col(split).alias("split")] if split else [F.lit("none").alias("split")]

    def level(name: str | None) -> DataFrame:
        at = [F.lit(name or OVERALL).alias("level"), (F.col(name).cast("string") if name else F.lit(OVERALL)).alias("name")]
        rows = base.where(F.col(name).isNotNull()) if name else base
        return rows.select(*head, *at, "_s", "_n").groupBy("split", "level", "name").agg(F.sum("_n").alias("n"), ratio(F.sum("_s"), F.sum("_n")).alias("accuracy"))

    return functools.reduce(DataFrame.unionByName, [level(x) for x in [None, *levels]])


def wide(report: DataFrame, names: list[str]) -> DataFrame:
    """U8: a report with a column for each name; a missing cell is null."""
    return report.groupBy("split").pivot("name", names).agg(F.first("accuracy"))


def macro(df: DataFrame, hit: Column, group: str, outer: list[str] | None = None) -> DataFrame:
    """The mean of the group means."""
    outer = outer or []
    means = df.withColumn("_hit", hit.cast("double")).groupBy(*outer, group).agg(F.avg("_hit").alias("_m"))
    return means.groupBy(*outer).agg(F.count("*").alias("groups"), F.avg("_m").alias("accuracy"))


def two_level(df: DataFrame, hit: Column, split: str, parent: str, child: str) -> DataFrame:
    """By split and over ALL splits, a parent's accuracy is the plain mean of its children's means; null (as NaN in
    the report) where one of its children has no row in the split."""
    base = df.withColumn("_hit", hit.cast("double")).groupBy(F.col(split).cast("string").alias("split"), parent, child).agg(F.sum("_hit").alias("_s"), F.count("_hit").alias("_n"))
    both = base.withColumn("split", F.explode(F.array("split", F.lit("ALL"))))
    children = both.groupBy("split", child).agg(ratio(F.sum("_s"), F.sum("_n")).alias("_m"))  # a child pools its parents
    expected = base.select(parent, child).distinct()
    per = expected.join(children, child).groupBy("split", parent).agg(F.count("*").alias("_c"), F.avg("_m").alias("_avg"))
    full = expected.groupBy(parent).agg(F.count("*").alias("_all"))
    return per.join(full, parent).select("split", parent, F.when(F.col("_c") == F.col("_all"), F.col("_avg")).alias("accuracy"))


def pivot_with_average(df: DataFrame, hit: Column, row: str, column: str, names: list) -> DataFrame:
    """Mean hit of row by column, 0 where there is none, and the mean of the row."""
    cells = df.withColumn("_hit", hit.cast("double")).groupBy(row).pivot(column, names).agg(F.avg("_hit")).na.fill(0.0)
    return cells.withColumn("Avg", functools.reduce(Column.__add__, [F.col(f"`{n}`") for n in map(str, names)]) / len(names))


def tree(df: DataFrame, hit: Column, *levels: str) -> DataFrame:
    """Micro accuracy at each depth of a tree of levels, by roll-up; ``depth`` levels are set."""
    out = df.withColumn("_hit", hit.cast("double")).rollup(*levels).agg(F.count("_hit").alias("n"), F.sum("_hit").alias("correct"), F.avg("_hit").alias("accuracy"), F.grouping_id().alias("_g"))
    return out.withColumn("depth", (F.lit(len(levels)) - F.bit_count("_g")).cast("int")).drop("_g")


def all_correct(df: DataFrame, hit: Column, group: list[str], least: int = 1) -> DataFrame:
    """A group counts only if every row of it is right and it has at least ``least`` rows."""
    return df.groupBy(*group).agg((F.bool_and(hit) & (F.count("*") >= least)).alias("hit"), F.count("*").alias("rows"))


def figure_question(df: DataFrame, hit: Column, question: list[str], figure: list[str], by: list[str]) -> DataFrame:
    """By ``by``, the mean over answers, over questions (all right) and over figures (all right)."""
    ok = df.withColumn("_hit", hit)
    mean = lambda key: ok.groupBy(*by, *key).agg(F.bool_and("_hit").cast("int").alias("_h")).groupBy(*by).agg(F.avg("_h").alias("_m"))
    out = ok.groupBy(*by).agg(F.avg(F.col("_hit").cast("int")).alias("aAcc"))
    for name, key in (("qAcc", question), ("fAcc", figure)):
        out = out.join(mean(key).withColumnRenamed("_m", name), by) if by else out.crossJoin(mean(key).withColumnRenamed("_m", name))
    return out


def rotations(df: DataFrame, hit: Column, item: list[str], rotation: str, names: list[int], by: str) -> DataFrame:
    """Of items that have every rotation: how many are right in all, in none, and the rate of each; with an
    Average row over the groups, whose count is cut to a whole number."""
    sides = [F.max(F.when(F.col(rotation) == r, F.col("_hit"))).alias(f"r{r}") for r in names]
    items = df.withColumn("_hit", hit.cast("int")).groupBy(*item, by).agg(*sides)
    items = items.where(functools.reduce(Column.__and__, [F.col(f"r{r}").isNotNull() for r in names]))
    total = functools.reduce(Column.__add__, [F.col(f"r{r}") for r in names])
    rates = [F.avg(f"r{r}").alias(f"rate_{r}") for r in names]
    groups = items.groupBy(F.col(by).cast("string").alias("name")).agg(F.count("*").alias("total"), F.avg((total == len(names)).cast("int")).alias("hit_all"), F.avg((total == 0).cast("int")).alias("miss_all"), *rates)
    means = groups.agg(F.lit("Average").alias("name"), F.floor(F.avg("total")).cast("long").alias("total"), *[F.avg(c).alias(c) for c in ("hit_all", "miss_all", *[f"rate_{r}" for r in names])])
    return groups.unionByName(means)


def confusion(df: DataFrame, truth: Column, prediction: Column, by: list[str]) -> DataFrame:
    """Counts and accuracy, precision, recall, F1; an empty denominator gives 0."""
    rows = df.withColumn("_t", truth).withColumn("_p", prediction)
    cell = lambda t, p: F.count_if((F.col("_t") == t) & (F.col("_p") == p))
    out = rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("accuracy", zero(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))))
    out = out.withColumn("precision", zero(ratio(F.col("tp"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(ratio(F.col("tp"), F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", zero(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def against_control(df: DataFrame, group: str, control: str, truth: Column, prediction: Column) -> DataFrame:
    """Each group with the shared control rows. The control's counts are added to each group's, so its rows are
    aggregated once and not copied to every group."""
    counts = confusion(df, truth, prediction, [group]).select(group, "tp", "fp", "fn", "tn")
    shared = counts.where(F.col(group) == control).select(*[F.col(c).alias(f"_{c}") for c in ("tp", "fp", "fn", "tn")])
    both = counts.where(F.col(group) != control).join(F.broadcast(shared))  # one row
    both = both.select(group, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return both.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def multi_label(df: DataFrame, hit: Column, labels: Column) -> DataFrame:
    """Counters of every label of a row, and of all rows as Overall."""
    rows = df.select(hit.cast("int").alias("_h"), F.explode(F.array_append(labels, F.lit(OVERALL))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("total"), F.sum("_h").alias("hits")).withColumn("rate", ratio(F.col("hits"), F.col("total")))


def count_errors(df: DataFrame, truth: Column, value: Column, by: list[str]) -> DataFrame:
    """Exact and off-by-one accuracy, mean absolute error and root mean square error, errors clamped to
    the greater of twice the truth and 100."""
    error = F.least(F.abs(value - truth), F.greatest(2 * truth, F.lit(100)))
    rows = df.withColumn("_e", error)
    return rows.groupBy(*by).agg(F.avg((F.col("_e") == 0).cast("int")).alias("acc"), F.avg((F.col("_e") <= 1).cast("int")).alias("oboa"), F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))


def at_thresholds(df: DataFrame, score: Column, thresholds: list[float], joint: Column | None = None) -> DataFrame:
    """The share of rows whose score reaches each threshold (and where ``joint`` holds), and their mean."""
    ok = lambda t: (score >= t) & (joint if joint is not None else F.lit(True))
    each = df.agg(*[F.avg(ok(t).cast("int")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(str(t)).alias("threshold"), F.col(f"t{i}").alias("rate")) for i, t in enumerate(thresholds)])
    return each.select(F.explode(rows).alias("r")).select("r.*").unionByName(each.select(F.lit("mean").alias("threshold"), (functools.reduce(Column.__add__, [F.col(f"t{i}") for i in range(len(thresholds))]) / len(thresholds)).alias("rate")))


def weighted_then_macro(df: DataFrame, page: str, error: Column, weight: Column) -> DataFrame:
    """Summed error over summed weight in a page, then the plain mean over pages."""
    pages = df.groupBy(page).agg(ratio(F.sum(error), F.sum(weight)).alias("_r"))
    return pages.agg(F.count("_r").alias("pages"), F.avg("_r").alias("score"))


def cycles(df: DataFrame, hit: Column, cycle: str, category: str) -> DataFrame:
    """Of each category, the sum of its per-cycle means over the number of all cycles, present or not."""
    per = df.withColumn("_hit", hit.cast("double")).groupBy(cycle, category).agg(F.avg("_hit").alias("_m"))
    n = F.broadcast(df.agg(F.count_distinct(cycle).alias("_n")))
    return per.groupBy(category).agg(F.sum("_m").alias("_s")).join(n).select(category, ratio(F.col("_s"), F.col("_n")).alias("accuracy"))


def flatten_metrics(df: DataFrame, split: str, metrics: list[str]) -> DataFrame:
    """Key ``split=X|metric`` and value; NaN and null cells are left out, infinite ones are refused."""
    long = df.unpivot([split], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    checked = F.when(F.abs("value") == float("inf"), F.raise_error(F.lit("a metric is infinite"))).otherwise(F.col("value"))
    return long.select(F.concat(F.lit("split="), F.col(split).cast("string"), F.lit("|"), F.col("metric")).alias("key"), checked.alias("value"))


def by_metric(df: DataFrame, metric: str, metrics: dict, response: Column, truth: Column) -> DataFrame:
    """``df`` with the score of each row by the measure that its column ``metric`` names; null for another name."""
    score = functools.reduce(lambda c, k: c.when(F.col(metric) == k, metrics[k](response, truth)), metrics, F.when(F.lit(False), F.lit(None).cast("double")))
    return df.withColumn("score", score)


def ngram_overlap(df: DataFrame, key: str, truth: str, found: str, most: int = 4) -> DataFrame:
    """GLEU (matches of up to ``most`` words over the larger number of n-grams) and unigram recall, precision and F1.
    N-grams are counted in groups by a 64-bit hash; no text is collected."""
    gram = lambda ws, n: F.transform(run_hashes(ws, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

    def side(c: str, own: str, other: str) -> DataFrame:
        ws = F.array_remove(F.split(F.lower(c), r"\s+"), "")
        grams = F.flatten(F.array(*[gram(ws, n) for n in range(1, most + 1)]))
        return df.select(key, F.explode(grams).alias("x")).select(key, "x.n", "x.g", F.lit(1).alias(own), F.lit(0).alias(other))

    counts = side(truth, "a", "b").unionByName(side(found, "b", "a")).groupBy(key, "n", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.withColumn("m", F.least("a", "b"))
    one = lambda c: F.sum(F.when(F.col("n") == 1, F.col(c)))
    sums = counts.groupBy(key).agg(F.sum("m").alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"), one("m").alias("m1"), one("a").alias("a1"), one("b").alias("b1"))
    f1 = F.coalesce(ratio(2 * F.col("m1"), F.col("a1") + F.col("b1")), F.lit(0.0))
    return sums.select(key, ratio(F.col("m"), F.greatest("a", "b")).alias("gleu"), ratio(F.col("m1"), F.col("a1")).alias("recall"), ratio(F.col("m1"), F.col("b1")).alias("precision"), f1.alias("f1"))


def listed_splits(df: DataFrame, split: str, hit: Column, value: Column, listed: list[str]) -> DataFrame:
    """Precision (of 100), mean value and rows of each split, and a row Average: the plain mean over the listed splits
    that have rows and their number of rows, or over all rows where none of them has any."""
    base = df.groupBy(F.col(split).alias("split")).agg(F.sum(hit.cast("long")).alias("h"), F.sum(value).alias("v"), F.count("*").alias("samples"))
    each = base.select("split", ratio(100 * F.col("h"), F.col("samples")).alias("precision"), ratio(F.col("v"), F.col("samples")).alias("mean_iou"), "samples", "h", "v")
    own = lambda c: F.when(F.col("split").isin(listed), F.col(c))
    total = lambda c: F.try_divide(F.sum(c).cast("double"), F.sum("samples"))
    average = each.agg(
        F.lit("Average").alias("split"), F.coalesce(F.avg(own("precision")), 100 * total("h")).alias("precision"),
        F.coalesce(F.avg(own("mean_iou")), total("v")).alias("mean_iou"), F.coalesce(F.sum(own("samples")), F.sum("samples")).alias("samples"),
    )
    return each.drop("h", "v").unionByName(average)


def merged_means(df: DataFrame, subject: str, category: str, measures: list[str]) -> DataFrame:
    """Means of the measures by subject, by category (named CATEGORY_...) and overall, from one grouping."""
    base = df.groupBy(subject, category).agg(*[f(m).alias(f"{k}_{m}") for m in measures for k, f in (("s", F.sum), ("n", F.count))])
    names = F.array(F.col(subject), F.concat(F.lit("CATEGORY_"), F.col(category)), F.lit(OVERALL))
    spread = base.withColumn("_subject", F.explode(names)).where(F.col("_subject").isNotNull())
    return spread.groupBy(F.col("_subject").alias("subject")).agg(*[ratio(F.sum(f"s_{m}"), F.sum(f"n_{m}")).alias(m) for m in measures])


def value_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """F54"""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_std"), sem(F.col(value)).alias("sem"))
