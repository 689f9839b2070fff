"""Row expanders that carry state from row to row, as table functions over a partitioned and ordered table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MARKER = "<image>"


class Segments:
    """The parts of each turn of a conversation, numbered through it: text, and an image wherever the marker stood. What
    it carries is two numbers, however long the conversation is."""

    def __init__(self) -> None:
        self.ordinal, self.chars = 0, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for i, part in enumerate((row["text"] or "").split(MARKER)):
            if i:
                yield row["conv_id"], row["turn"], 2 * i - 1, "image", None, False, self.ordinal, self.chars
                self.ordinal += 1
            if part.strip(" "):
                yield row["conv_id"], row["turn"], 2 * i, "text", part, row["role"] == "assistant", self.ordinal, self.chars
                self.ordinal, self.chars = self.ordinal + 1, self.chars + len(part)


RETURNS = "conv_id long, turn long, position int, kind string, value string, loss boolean, ordinal long, chars_before long"


def numbered_segments(df: DataFrame) -> DataFrame:
    """B7 with state: conv_id, turn, position (within the turn), kind, value, loss, ordinal (within the conversation) and
    chars_before (of text, up to here) of every segment of ``df`` (conv_id, turn, role, text).

    Turns come by number, equal ones by role and text; a null text has no segments; rows without a conversation are one
    conversation; other columns are left out; no rows give none.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    expand = udtf(Segments, returnType=RETURNS)
    return expand(rows.asTable().partitionBy("conv_id").orderBy("turn", "role", "text"))


def register(spark: SparkSession, name: str = "numbered_segments") -> None:
    """For SQL: ``SELECT * FROM numbered_segments(TABLE(t) PARTITION BY conv_id ORDER BY turn)``."""
    spark.udtf.register(name, udtf(Segments, returnType=RETURNS))
