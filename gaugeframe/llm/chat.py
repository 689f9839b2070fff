"""Chat formatting: a finite-state machine over roles, and a declarative template.

The rows of a conversation are sorted by turn and streamed through the machine, which checks the order of roles and
emits text segments, each with a flag that says whether it counts for the loss. Nothing is held but the current turn,
so a conversation may be of any length.

Control strings inside texts and roles are escaped: a backslash doubles, and ``<|`` becomes ``<\\|``, so a marker in
the output is always the template's own; reading back undoes it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands before, inside and after a turn, which roles count for the loss, and which role may follow which."""

    open: str = "<|im_start|>"
    head: str = "\n"
    close: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


CHATML = Template()


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(text, counts for the loss) of a turn. The markers never count, the text does for the roles of ``loss``."""
    # A newline ends the role in the output, so one inside a role is escaped too.
    name = escape(role).replace("\n", "\\\n")
    return [(template.open + name + template.head, False), (escape(text), role in template.loss), (template.close, False)]


def format_turns(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, seq, segment, loss, error): three segments a turn, in the order of seq within each partition.

    ``error`` names a role that may not follow the one before it, on the first segment of its turn, else null.
    Defined cases: a null role or text is empty; turns sort nulls first, then by role and text where they tie, and
    repeated rows are turns of their own; a null conv_id is a conversation of its own. Other columns are left out.
    """
    clean = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, seq = object(), "", 0
        for b in batches:
            out = []
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                if conv != at:
                    at, state, seq = conv, "", 0
                error = None if role in template.follows.get(state, ()) else f"{role or 'no role'} after {state or 'the start'}"
                state = role
                for piece, loss in segments(role, text, template):
                    out.append((conv, seq, piece, loss, error))
                    seq, error = seq + 1, None
            yield pd.DataFrame(out, columns=["conv_id", "seq", "segment", "loss", "error"])

    return placed.mapInPandas(run, "conv_id string, seq long, segment string, loss boolean, error string")


class Reader:
    """Reads one conversation's formatted segments back, piece by piece: digests of turns and of what counts."""

    def __init__(self, template: Template) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.errors, self.template, self.pending = 0, template, ""

    def feed(self, piece: str, loss: bool) -> None:
        self.chars += len(piece)
        self.pending += piece
        if loss:
            text = unescape(piece)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if not piece.endswith(self.template.close) or not self.pending.startswith(self.template.open):
            return
        body = self.pending[len(self.template.open) : -len(self.template.close)]
        role, text = re.fullmatch(r"((?:\\.|[^\\\n])*)\n(.*)", body, re.DOTALL).groups()
        self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.n_turns, self.pending = self.n_turns + 1, ""


def read_back(formatted: DataFrame, kind: str, template: Template = CHATML) -> DataFrame:
    """A row a conversation, read from the segments of ``format_turns`` in whatever order they were stored: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_errors (turns that the machine refuses). A
    conversation that ends with the user's turn is no error: it may go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_errors"]
        at, reader = None, None

        def row() -> tuple:
            return at, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, reader.errors

        for b in batches:
            out = []
            for conv, seq, piece, loss, error in zip(b["conv_id"], b["seq"], b["segment"], b["loss"], b["error"], strict=True):
                if seq == 0:
                    out += [row()] if reader else []
                    at, reader = conv, Reader(template)
                reader.errors += error is not None
                reader.feed(piece, loss)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([row()] if reader else [], columns=names)

    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long"
    placed = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return placed.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(kind))
