"""Further benchmark scores: paired groups, multi-step mastery, weighted fields, bootstrap and permutation."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.stats import ratio
from gaugeframe.operators.resampling import poisson, signs, sums_by_draw


def natural_groups(df: DataFrame, group: str, q0i0: str, q0i1: str, q1i0: str, q1i1: str) -> DataFrame:
    """A row a group of two questions and two images, with 0/1 answers: yes is right for (q0, i0) and (q1, i1), no
    for the others. Q, I: both answers to a question, about an image, are right; G: all four."""
    a, b, c, d = F.col(q0i0) == 1, F.col(q0i1) == 0, F.col(q1i0) == 0, F.col(q1i1) == 1
    n = lambda x: x.cast("int")
    return df.agg(
        (F.sum(n(a & b) + n(d & c)) / (2.0 * F.count(group))).alias("Q_Acc"),
        (F.sum(n(a & c) + n(d & b)) / (2.0 * F.count(group))).alias("I_Acc"),
        (F.sum(n(a) + n(b) + n(c) + n(d)) / (4.0 * F.count(group))).alias("Acc"),
        F.avg(n(a & b & c & d)).alias("G_Acc"),
    )


def paired_answers(df: DataFrame, category: str, image: str, order: str, score: str) -> DataFrame:
    """Of each category, 100 times the mean score plus 100 times the mean product of an image's first two scores;
    an image with one score has no product."""
    at = F.struct(F.col(order), F.col(score).alias("s"))
    pair = F.slice(F.array_sort(F.collect_list(at)), 1, 2)
    images = df.groupBy(category, image).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"), pair.alias("_p"))
    images = images.withColumn("_plus", F.when(F.size("_p") == 2, F.col("_p")[0]["s"] * F.get("_p", F.lit(1))["s"]))
    out = images.groupBy(category).agg(ratio(F.sum("_s"), F.sum("_n")).alias("acc"), F.avg("_plus").alias("plus"))
    return out.select(category, (100 * F.col("acc")).alias("acc"), (100 * F.col("plus")).alias("plus"), (100 * (F.col("acc") + F.col("plus"))).alias("score"))


def mastery(df: DataFrame, steps: list[str], whole: str) -> DataFrame:
    """Counts of a multi-step problem's four outcomes. ``steps`` may be null where a problem has fewer."""
    right = [F.coalesce(F.col(s), F.lit(True)) for s in steps]
    wrong = [~F.coalesce(F.col(s), F.lit(True)) for s in steps]
    some = [F.coalesce(F.col(s), F.lit(False)) for s in steps]
    every = functools.reduce(Column.__and__, right)
    any_wrong, any_right = functools.reduce(Column.__or__, wrong), functools.reduce(Column.__or__, some)
    none = ~any_right
    w = F.col(whole)
    counts = df.agg(
        F.count_if(none & w).alias("rote_loose"), F.count_if(any_wrong & w).alias("rote_strict"), F.count_if(every & ~w).alias("inadequate"), F.count_if(any_wrong & ~w).alias("insufficient"),
        F.count_if(any_right & w).alias("mastery_loose"), F.count_if(every & w).alias("mastery_strict"), F.count("*").alias("total"),
    )
    score = lambda rote: (F.col("total") - 0.5 * F.col("inadequate") - F.col(rote) - F.col("insufficient")) / F.col("total")
    return counts.withColumn("score_loose", score("rote_loose")).withColumn("score_strict", score("rote_strict"))


def weighted_fields(df: DataFrame, task: str, item: str, score: str, weight: str, smallest: bool = False) -> DataFrame:
    """Field scores to a weighted mean (or the smallest) of an item, to the mean of a task; then the mean over tasks
    (macro) and over items (micro). Negative scores are invalid and left out."""
    valid = df.where(F.col(score) >= 0)
    one = F.min(score) if smallest else ratio(F.sum(F.col(score) * F.col(weight)), F.sum(weight))
    items = valid.groupBy(task, item).agg(one.alias("_i"))
    tasks = items.groupBy(task).agg(F.avg("_i").alias("_t"), F.sum("_i").alias("_s"), F.count("_i").alias("_n"))
    return tasks.agg(F.count("*").alias("tasks"), F.avg("_t").alias("macro"), ratio(F.sum("_s"), F.sum("_n")).alias("micro"))


def count_penalty(truth: Column, value: Column, length: Column, longest: int = 4, factor: float = 2.0) -> Column:
    """100 for the right count; else less by the error relative to the greatest one, weighted by how short the
    sequence is; 0 for no number."""
    error = F.abs(value - truth)
    most = F.greatest(truth - 1, length - truth, F.lit(1))
    penalty = (F.lit(float(longest)) / length) * F.pow(error / most, F.lit(1 / factor))
    return F.when(value.isNull(), 0.0).when(error == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 * (1 - penalty)))


def ratio_of_least(long: Column, clue: Column) -> Column:
    """A33"""
    return F.when(clue == 0, 0.0).otherwise(F.least(long, clue) / F.nullif(clue, F.lit(0.0)))


def counters(df: DataFrame, category: str, hit: Column, groups: dict[str, list[str]], norm: float = 10.0) -> DataFrame:
    """Hits by named groups of categories, their sum, and the sum over ``norm``."""
    each = [F.count_if(hit & F.col(category).isin(cs)).alias(name) for name, cs in groups.items()]
    out = df.agg(*each)
    out = out.withColumn("Final Score", functools.reduce(Column.__add__, [F.col(f"`{g}`") for g in groups]))
    return out.withColumn("Final Score Norm", F.col("Final Score") / norm)


def first_mode(df: DataFrame, value: str, order: str) -> DataFrame:
    """The commonest value; of equals the one seen first."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first").limit(1).drop("_first")


def bootstrap_ci(df: DataFrame, score: str, category: str | None = None, draws: int = 1000, level: float = 0.95, seed: int = 0, key: str | None = None) -> DataFrame:
    """Percentile interval of the mean (or of the mean of category means) over resamples.

    A resample gives each row a Poisson(1) count from a hash of row and draw, so the rows stay where they are and only
    sums by draw are shuffled: the usual distributed form of drawing with replacement. A row is known by ``key``, or by
    all its values, so the result doesn't depend on how the rows are dealt. Counts are made as matrices of rows by draws
    and multiplied in the task, which leaves a sum for each category and draw. Rows without a score are left out; a draw
    that takes no row of a category leaves that out, and no rows give nulls.
    """
    sums = sums_by_draw(df, F.col(category) if category else F.lit(""), F.col(score), F.xxhash64(*([key] if key else df.columns)), draws, seed, poisson)
    means = sums.where("weight > 0").groupBy("draw").agg(F.avg(F.col("total") / F.col("weight")).alias("_m"))
    alpha = (1 - level) / 2
    return means.agg(F.percentile("_m", alpha).alias("low"), F.percentile("_m", 1 - alpha).alias("high"))


def permutation_p(df: DataFrame, a: str, b: str, draws: int = 1000, seed: int = 0, key: str | None = None) -> DataFrame:
    """Two-sided Monte-Carlo test of paired scores: signs of the differences are flipped by a hash of row and draw,
    as matrices of rows by draws; the differences as they are come beside them as draw 0. A row is known by ``key``, or by
    all its values; pairs without both scores are left out."""
    difference, row = F.col(a) - F.col(b), F.xxhash64(*([key] if key else df.columns))
    plain = lambda hashes: np.concatenate([np.ones((len(hashes), 1)), signs(hashes[:, 1:])], axis=1)
    sums = sums_by_draw(df, F.lit(""), difference, row, draws + 1, seed, plain).select("draw", F.abs("total").alias("_y"))
    of = sums.agg(F.max(F.when(F.col("draw") == 0, F.col("_y"))).alias("observed"), F.collect_list(F.when(F.col("draw") > 0, F.col("_y"))).alias("_all"))  # a number a draw
    return of.select("observed", (F.size(F.filter("_all", lambda y: y >= F.col("observed") - 1e-12)) / F.lit(float(draws))).alias("p")).withColumn("p", F.when(F.col("observed").isNotNull(), F.col("p")))


def located_counts(gt: list, found: list) -> float:
    """root of mean best overlap times a penalty for the wrong number, over (start, end) spans."""
    overlap = lambda g, p: max(0.0, min(g[1], p[1]) - max(g[0], p[0])) / max(1e-12, max(g[1], p[1]) - min(g[0], p[0]))
    best = sum(max((overlap(g, p) for p in found), default=0.0) for g in gt) / len(gt) if gt else 0.0
    return math.sqrt(best * max(0.0, 1 - abs(len(found) - len(gt)) / max(1, len(gt))))


def weighted_draws(df: DataFrame, group: str, weights: dict[str, float], ordinal: str, seed: int = 0) -> DataFrame:
    """The group from which each position of a stream is drawn, by cumulative weights and a hash of the position."""
    total, bound, out = sum(weights.values()), 0.0, None
    u = F.pmod(F.xxhash64(F.col(ordinal), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    for name, w in weights.items():
        bound += w / total
        out = F.when(u < bound, name) if out is None else out.when(u < bound, name)
    return df.withColumn(group, out.otherwise(list(weights)[-1]))


def tree_similarity(a: tuple, b: tuple) -> float:
    """1 minus the edit distance of two ordered trees, (label, children), over the larger one's size.

    Zhang and Shasha: forests by postorder numbers and leftmost leaves, key roots first.
    """

    def flat(t: tuple) -> tuple[list, list[int]]:
        labels, left = [], []

        def walk(n: tuple) -> int:
            firsts = [walk(c) for c in n[1]]
            labels.append(n[0])
            left.append(firsts[0] if firsts else len(labels) - 1)
            return left[-1]

        walk(t)
        return labels, left

    (la, ea), (lb, eb) = flat(a), flat(b)
    keys = lambda e: sorted({x: i for i, x in enumerate(e)}.values())
    d = np.zeros((len(la), len(lb)))
    for i in keys(ea):
        for j in keys(eb):
            f = np.zeros((i - ea[i] + 2, j - eb[j] + 2))
            f[:, 0], f[0, :] = np.arange(f.shape[0]), np.arange(f.shape[1])
            for x in range(ea[i], i + 1):
                for y in range(eb[j], j + 1):
                    p, q = x - ea[i] + 1, y - eb[j] + 1
                    if ea[x] == ea[i] and eb[y] == eb[j]:
                        f[p, q] = d[x, y] = min(f[p - 1, q] + 1, f[p, q - 1] + 1, f[p - 1, q - 1] + (la[x] != lb[y]))
                    else:
                        f[p, q] = min(f[p - 1, q] + 1, f[p, q - 1] + 1, f[ea[x] - ea[i], eb[y] - eb[j]] + d[x, y])
    return 1 - float(d[-1, -1]) / max(len(la), len(lb))


def corpus_cider(df: DataFrame, key: str, truth: str, found: str, most: int = 4) -> DataFrame:
    """CIDEr of one reference each: cosines of n-gram vectors weighted by how few references hold the n-gram,
    averaged over n, times ten. Counting is a join on n-grams; no text is collected."""
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), " "))
    rows = df.select(key, F.split(F.lower(truth), r"\s+").alias("_t"), F.split(F.lower(found), r"\s+").alias("_f"))
    total = df.count()

    def side(c: str) -> DataFrame:
        named = lambda n: F.transform(grams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
        every = F.flatten(F.array(*[named(n) for n in range(1, most + 1)]))
        return rows.select(key, F.explode(every).alias("x")).groupBy(key, "x.n", "x.g").agg(F.count("*").alias("c"))

    t, f = side("_t"), side("_f")
    idf = t.groupBy("n", "g").agg(F.count("*").alias("df"))
    weigh = lambda s, name: s.join(idf, ["n", "g"], "left").select(key, "n", "g", (F.col("c") * F.log(F.lit(float(max(total, 1))) / F.coalesce("df", F.lit(1)))).alias(name))
    both = weigh(t, "a").join(weigh(f, "b"), [key, "n", "g"], "full").na.fill(0.0, ["a", "b"])
    cos = both.groupBy(key, "n").agg(F.coalesce(ratio(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b")))), F.lit(0.0)).alias("c"))
    return cos.groupBy(key).agg((10 * F.avg("c")).alias("cider"))

