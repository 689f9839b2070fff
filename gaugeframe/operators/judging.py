"""Judging as a seam: a callable decides what rules can't, under a policy; and registries of scorers and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions import text as T
from gaugeframe.operators import reports

POLICIES = ("exact_matching", "legacy", "llm_first")
FALLBACK, UNRESOLVED = "Exact matching fallback:", "Unresolved LLM judge response."


def asked(judge: Callable[[str], str], prompt: str, tries: int = 3) -> str | None:
    """The judge's reply; null after ``tries`` failures."""
    for _ in range(tries):
        try:
            return judge(prompt)
        except Exception:  # noqa: BLE001 - a judge may fail in any way
            continue
    return None


def judged_options(df: DataFrame, prediction: str, options: list[str], prompt: str, judge: Callable[[str], str] | None = None, policy: str = "exact_matching") -> DataFrame:
    """``df`` with ``option`` and ``log``. exact_matching never asks; legacy asks where the rules find nothing;
    llm_first asks always, and falls back to the rules only if the judge can't be reached. What stays open is Z."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    ruled = df.withColumn("_rule", T.infer(F.col(prediction), {o: F.col(o) for o in options}))
    if policy == "exact_matching" or judge is None:
        return ruled.withColumn("option", F.coalesce("_rule", F.lit("Z"))).withColumn("log", F.lit("")).drop("_rule")
    choices = set(options) | {"Z"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rule, text in zip(b["_rule"], b["_prompt"], strict=True):
                if policy == "legacy" and rule is not None:
                    out.append((rule, ""))
                    continue
                reply = asked(judge, text)
                letter = next((w for w in (reply or "").replace(".", " ").split() if w in choices), None)
                if reply is None:
                    out.append((rule or "Z", f"{FALLBACK} {rule or 'Z'}"))
                else:
                    out.append((letter or "Z", "" if letter else UNRESOLVED))
            yield b.drop(columns=["_rule", "_prompt"]).assign(option=[x[0] for x in out], log=[x[1] for x in out])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "option string", "log string"])
    return ruled.withColumn("_prompt", F.col(prompt)).mapInPandas(run, schema)


def majority(votes: Column) -> Column:
    """The verdict of an array of 0 and 1 votes: 1 if more than half are; null for none. (From the description of a
    consensus of judges, whose code isn't published.)"""
    total = F.aggregate(votes, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(F.size(votes) > 0, (2 * total > F.size(votes)).cast("int"))


@dataclass(frozen=True)
class Benchmark:
    """How a benchmark's rows are scored and rolled up."""

    name: str
    hit: Callable[[DataFrame], Column]
    report: Callable[[DataFrame, Column], DataFrame]
    needs: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Benchmark] = {}


def register(benchmark: Benchmark) -> Benchmark:
    REGISTRY[benchmark.name] = benchmark
    return benchmark


def option_hit(df: DataFrame) -> Column:
    options = [c for c in df.columns if len(c) == 1 and c.isupper()]
    return F.coalesce(T.infer(F.col("prediction"), {o: F.col(o) for o in options}) == F.col("answer"), F.lit(False)).cast("int")


def text_hit(df: DataFrame) -> Column:
    return (F.lower(F.trim("prediction")) == F.lower(F.trim("answer"))).cast("int")


def _levels(df: DataFrame, hit: Column) -> DataFrame:
    return reports.by_levels(df, hit, "split" if "split" in df.columns else None, [c for c in ("l2-category", "category") if c in df.columns])


MCQ = register(Benchmark("MCQ", option_hit, _levels, ("prediction", "answer", "A", "B")))
VQA = register(Benchmark("VQA", text_hit, _levels, ("prediction", "answer")))
SOURCES = register(Benchmark("CV-Bench-2D", option_hit, lambda df, hit: reports.macro(df, hit, "source"), ("prediction", "answer", "source")))


def kind_of(df: DataFrame) -> Benchmark:
    """Multiple choice where there are options A and B, else question and answer."""
    return MCQ if {"A", "B"} <= set(df.columns) else VQA


def evaluate(df: DataFrame, name: str | None = None) -> DataFrame:
    benchmark = REGISTRY[name] if name else kind_of(df)
    if lacking := [c for c in benchmark.needs if c not in df.columns]:
        raise ValueError(f"{benchmark.name} needs {lacking}")
    return benchmark.report(df, benchmark.hit(df))
