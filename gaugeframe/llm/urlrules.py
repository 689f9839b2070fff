"""URL filters as a sort-merge range join.

A host is turned round label by label into a canonical key (``blog.example.net`` becomes ``net.example.blog.``), so
a host with all its subdomains is an interval of keys. Addresses and rules are dealt into ranges of keys, each rule
to every range that its interval touches; within a range both are sorted together and swept once, with a stack of
the hosts whose intervals are open. The rules of one host come in the order of their paths, and each remembers the
longest path before it that is a beginning of its own: the rules that fit an address's path are found by one bisection
and then from path to shorter path, however many rules a host has. Of all rules that fit, the longest wins.

The bounds of the ranges come from a bounded sample (``SAMPLE`` keys); they decide about balance, not about results.
A key that fills several ranges is spread over them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, RANGES = 8192, 4
#: Sorts after every character that a key can hold.
LAST = chr(0x10FFFF)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """The labels from the last to the first, each followed by a dot; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def reversed_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Host:
    """The rules of one host in the order of their paths, which nest like a stack: ``up`` leads from a path to the
    longest other one that it begins with."""

    def __init__(self, key: str) -> None:
        self.key, self.paths, self.up, self.rules = key, [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:  # the same rule again: a block wins
            if verdict == "block":
                self.rules[-1] = (rule, verdict)
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.up[at]
        self.paths.append(path), self.up.append(at), self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.up[at]
        return self.rules[at] if at >= 0 else None


class Sweep:
    """One pass over rules and addresses sorted by range, key and path, a rule before the addresses that its key precedes."""

    def __init__(self) -> None:
        self.at, self.stack = None, []

    def step(self, bucket: int, key: str, kind: int, path: str, rule: str | None, verdict: str | None) -> tuple | None:
        """The winning rule of an address and its verdict; rules only go on the stack."""
        if bucket != self.at:
            self.at, self.stack = bucket, []
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        if kind == 0:
            if not self.stack or self.stack[-1].key != key:
                self.stack.append(Host(key))
            self.stack[-1].add(path, rule, verdict)
            return None
        return max((r for h in self.stack if (r := h.longest(path))), key=lambda r: (len(r[0]), r[0], r[1] == "block"), default=None)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (host and path of the winning rule, else null) and verdict.

    ``rules`` has host, path and verdict (allow or block). Of equally long rules the greater text wins, of the same
    rule twice the block. Defined cases: a null address or one without ``://`` has an empty host and path and fits no
    rule of a host; rules with a null field are left out; repeated addresses are judged alike; a long address is looked at
    whole; existing columns named host, path, rule or verdict are replaced. An empty rule table gives the default
    everywhere.
    """
    spark = urls.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    kept = urls.select(F.struct(*names).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kept = kept.withColumn("key", F.concat(key_of(F.col("host")), F.lit("\x01"), F.col("path")))
    # Hashes are uniform: a task sends the driver its share of the sample and no more.
    share, at = min(1.0, (1.5 * SAMPLE + 64) / max(urls.count(), 1)), F.pmod(F.xxhash64("key", "row"), F.lit(1 << 32))
    sampled = sorted(r["key"] for r in kept.where(at < share * float(1 << 32)).select("key", at.alias("h")).orderBy("h", "key").limit(SAMPLE).collect())
    bounds = [sampled[len(sampled) * i // ranges] for i in range(1, ranges)] if sampled else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, spread: pd.Series) -> pd.Series:
        lo, hi = [bisect_left(bounds, k) for k in key], [bisect_right(bounds, k) for k in key]
        return pd.Series([a + s % (b - a + 1) for a, b, s in zip(lo, hi, spread, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + LAST) + 1)) for k in key])

    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    shape = ["bucket", "key", "kind", "row", "host", "path", "rule", "verdict"]
    opened = usable.select(
        F.explode(ranges_of(key_of(F.col("host")))).alias("bucket"), key_of(F.col("host")).alias("key"), F.lit(0).alias("kind"),
        F.lit(None).cast(kept.schema["row"].dataType).alias("row"), "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    )
    asked = kept.select(
        range_of(F.col("key"), F.pmod(F.xxhash64("row"), F.lit(1 << 30)).cast("int")).alias("bucket"), "key", F.lit(1).alias("kind"),
        "row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    together = asked.select(shape).unionByName(opened.select(shape)).repartition("bucket").sortWithinPartitions("bucket", "key", "kind", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sweep = Sweep()
        for b in batches:
            best = [sweep.step(*x) for x in zip(b["bucket"], b["key"], b["kind"], b["path"], b["rule"], b["verdict"], strict=True)]
            found = b[["row", "host", "path"]].assign(rule=[x and x[0] for x in best], verdict=[x[1] if x else default for x in best])
            yield found[b["kind"] == 1]

    kind = kept.schema["row"].dataType.simpleString()
    return together.mapInPandas(run, f"row {kind}, host string, path string, rule string, verdict string").select("row.*", "host", "path", "rule", "verdict")
