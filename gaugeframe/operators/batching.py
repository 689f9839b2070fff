"""Token accounting, sequence packing, curriculum phases and conversation segments."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.operators.sampling import ranged, sliced_rank


def budget_rounded(samples: Column, batch: int) -> Column:
    """Up to whole updates."""
    return F.ceil(samples / F.lit(batch)) * batch


def segments(df: DataFrame, marker: str = "<image>") -> DataFrame:
    """The ordered parts of each turn: text, and an image wherever the marker stood. Only text of the assistant
    counts for the loss; empty texts are left out."""
    parts = df.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), F.lit(marker))).alias("part", "value"))
    text = parts.where("trim(value) <> ''").select("conv_id", "turn", (2 * F.col("part")).alias("position"), F.lit("text").alias("kind"), "value", (F.col("role") == "assistant").alias("loss"))
    image = parts.where("part > 0").select("conv_id", "turn", (2 * F.col("part") - 1).alias("position"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("loss"))
    return text.unionByName(image)


def tokens_of(num_tokens: Column, segments: Column) -> Column:
    """Two tokens more for each segment."""
    return num_tokens + 2 * segments


class Packer:
    """B1: fills sequences in order, with a bounded buffer for samples that don't fit.

    While a sequence is shorter than ``prefer`` the buffer is served first. A sample that would overflow waits in the
    buffer, unless that is full or it came from there: then the sequence ends (and that sample is gone, as it was
    already taken). A sequence also ends when it reaches ``expected``.
    """

    def __init__(self, expected: int = 32768, most: int = 36864, longest: int = 16384, prefer: int = 16384, buffer: int = 50) -> None:
        self.expected, self.most, self.longest, self.prefer, self.room = expected, most, longest, prefer, buffer
        self.waiting: deque[tuple] = deque()
        self.pack, self.length, self.place = 0, 0, 0

    def end(self) -> None:
        self.pack, self.length, self.place = self.pack + 1, 0, 0

    def offer(self, uid: object, n: int, waited: bool) -> tuple | None:
        if n > self.longest:
            return None
        if self.length + n > self.most:
            if not waited and len(self.waiting) < self.room:
                self.waiting.append((uid, n))
            else:
                self.end()
            return None
        row = (self.pack, uid, self.place, n)
        self.length, self.place = self.length + n, self.place + 1
        if self.length >= self.expected:
            self.end()
        return row

    def run(self, samples: Iterator[tuple]) -> Iterator[tuple]:
        """(pack, uid, place, tokens) of every sample that is packed; what still waits at the end of the input stays out."""
        samples = iter(samples)
        while True:
            waited = bool(self.waiting) and self.length < self.prefer
            try:
                uid, n = self.waiting.popleft() if waited else next(samples)
            except StopIteration:
                return
            if (row := self.offer(uid, n, waited)) is not None:
                yield row


def packed(df: DataFrame, worker: str, order: str, uid: str, tokens: str, **limits: int) -> DataFrame:
    """(worker, pack, uid, place, tokens): each worker's rows packed in order, streamed, one worker after the other."""
    rows = df.select(F.col(worker).cast("int").alias("worker"), F.col(order).alias("order"), F.col(uid).cast("string").alias("uid"), F.col(tokens).cast("long").alias("tokens"))
    rows = rows.repartition("worker").sortWithinPartitions("worker", "order", "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feed = ((w, u, n) for b in batches for w, u, n in zip(b["worker"], b["uid"], b["tokens"], strict=True))
        out, ahead = [], next(feed, None)
        while ahead is not None:
            at = ahead[0]

            def own() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[0] == at:
                    yield ahead[1], int(ahead[2])
                    ahead = next(feed, None)

            for row in Packer(**limits).run(own()):
                out.append((at, *row))
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=["worker", "pack", "uid", "place", "tokens"])
                    out = []
            for _ in own():  # nothing is left but what the packer didn't ask for
                pass
        yield pd.DataFrame(out, columns=["worker", "pack", "uid", "place", "tokens"])

    return rows.drop("order").mapInPandas(run, "worker int, pack long, uid string, place long, tokens long")


def phase(drawn_before: Column, budgets: list[int]) -> Column:
    """The phase in which a sample is drawn, by the number of target samples before it; the last one is open."""
    out, total = None, 0
    for i, b in enumerate(budgets[:-1]):
        total += b
        out = F.when(drawn_before < total, i) if out is None else out.when(drawn_before < total, i)
    return F.lit(0) if out is None else out.otherwise(len(budgets) - 1)


def fixed_draws(df: DataFrame, group: str, order: str, fits: Column, plan: dict[str, tuple[int, int, int]]) -> DataFrame:
    """B2: the micro-batch of each row that fits, when every group gives a fixed number of rows to a batch. ``plan`` has the
    number, the interval and the offset of each group: it takes part in the batches whose number leaves the offset over
    the interval. Rows that don't fit are skipped and take no place; groups without a plan give nothing."""
    known = df.where(fits & F.col(group).isin(list(plan)))
    placed = sliced_rank(ranged(known, group, order), [group], "_piece", [order], "_i")
    batch = F.when(F.lit(False), F.lit(None).cast("long"))
    for name, (number, interval, offset) in plan.items():
        batch = batch.when(F.col(group) == name, F.floor(F.col("_i") / number) * interval + offset)
    return placed.withColumn("batch", batch).drop("_i", "_piece")


def attended(splits: DataFrame, sample: str, place: str, length: str, mode: str) -> DataFrame:
    """Which spans of a packed sample see which: (sample, queries from, to, keys from, to, causal). A split sees
    itself, token by token if it is causal, and what stands before it but for noise; nothing else sees noise. Spans, not
    pairs of tokens: a mask is made of them where it is needed."""
    w = Window.partitionBy(sample).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    at = splits.select(sample, place, mode, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("int").alias("start"), F.col(length).alias("_n"))
    at = at.withColumn("end", (F.col("start") + F.col("_n")).cast("int")).drop("_n")
    q, k = at.alias("q"), at.alias("k")
    seen = q.join(k, (F.col(f"q.{sample}") == F.col(f"k.{sample}")) & ((F.col(f"q.{place}") == F.col(f"k.{place}")) | ((F.col(f"k.{place}") < F.col(f"q.{place}")) & (F.col(f"k.{mode}") != "noise"))))
    own = F.col(f"q.{place}") == F.col(f"k.{place}")
    return seen.select(F.col(f"q.{sample}").alias(sample), F.col("q.start").alias("q_start"), F.col("q.end").alias("q_end"), F.col("k.start").alias("k_start"), F.col("k.end").alias("k_end"), (own & (F.col(f"q.{mode}") == "causal")).alias("causal"))
