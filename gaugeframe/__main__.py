"""X11: ``python -m gaugeframe MODE ...`` over files that the readers know: circular, merge, missing, scan, report, convert."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.text import FAILURE
from gaugeframe.operators import joins, reports, reshape
from gaugeframe.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gaugeframe")
    modes = out.add_subparsers(dest="mode", required=True)

    def mode(name: str, about: str, *files: str) -> argparse.ArgumentParser:
        p = modes.add_parser(name, help=about)
        for f in files:
            p.add_argument(f, nargs="+" if f == "parts" else None)
        return p

    p = mode("circular", "every rotation of the options of a question table", "table", "out")
    p.add_argument("--options", default="ABCD")
    mode("merge", "tables of one kind as one, each row with its file", "parts", "out")
    mode("missing", "cells of a grid, from a table of models and one of datasets, that have no row", "results", "models", "datasets", "out")
    mode("scan", "rows, failed predictions and their share", "table")
    p = mode("report", "accuracy overall and by columns", "table", "out")
    p.add_argument("--split")
    p.add_argument("--by", nargs="*", default=[])
    mode("convert", "another format, by suffix", "table", "out")
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The result of a mode; where the mode has an output it is written too."""
    load = lambda path: readers.load(spark, path)
    if a.mode == "circular":
        df = reshape.circular_variants(load(a.table).withColumn("index", F.col("index").cast("long")), list(a.options), "answer", "index")
    elif a.mode == "merge":
        df = reshape.tagged_union({p: load(p) for p in a.parts}, "file")
    elif a.mode == "missing":
        found = joins.grid_difference(load(a.results).select("model", "dataset"), load(a.models).select("model"), load(a.datasets).select("dataset"))
        df = found.where("status = 'missing'").drop("status")
    elif a.mode == "scan":
        failed = F.contains("prediction", F.lit(FAILURE))
        return load(a.table).agg(F.count("*").alias("rows"), F.count_if(failed).alias("failed"), F.avg(failed.cast("int")).alias("share"))
    elif a.mode == "report":
        df = reports.by_levels(load(a.table), F.col("hit").cast("double"), a.split, a.by)
    else:
        df = load(a.table)
    writers.dump(df, a.out)
    return df


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), parser().parse_args()).show(truncate=False)
