"""BPE as a streaming transducer, for vocabularies with word ends, and its incremental decoder.

Encoding goes through four layers, each of which holds back no more than a bounded rest of what it was fed: special
tokens, normalisation, pieces (runs of letters or of symbols, single digits, contractions), and merges. A piece may be
of any length. The merge list tells how far a merge can depend on what follows: that many bytes are the list's
sufficient lookahead, and a token that ends at least so far before what was read is final. So a piece is merged block
by block, final tokens leave, and the rest goes on with the next block.

That the block may start at a token's end, whatever came before, is a property of proper lists, in which each merge
joins symbols that the merges before it made: there, any stretch of a text's tokens is the encoding of its own bytes.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# What the vocabulary file asks for before merging. Other files are refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def members(kind: str, most: int) -> str:
    """The code points of a general category, as ranges of a character class: by Python's own tables, so a script that
    a later Unicode adds counts as symbols."""
    codes = [c for c in range(most + 1) if unicodedata.category(chr(c))[0] == kind]
    firsts = [c for c, before in zip(codes, [-2, *codes], strict=False) if c != before + 1]
    lasts = [c for c, after in zip(codes, [*codes[1:], -2], strict=True) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


#: White space of the vocabulary's pattern.
SPACES = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def patterns(most: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Letters, symbols and pieces up to a code point."""
    letter, digit = (members(kind, ord(most)) for kind in "LN")
    runs = [f"[{letter}]+", f"[{digit}]", f"[^{SPACES}{letter}{digit}]+"]
    piece = PATTERN.replace(r"[\p{L}]+", runs[0]).replace(r"[\p{N}]", runs[1]).replace(r"[^\s\p{L}\p{N}]+", runs[2])
    return re.compile(runs[0]), re.compile(runs[2]), re.compile(piece)


#: For any text, and for one within the first plane, where classes are tables and not lists of ranges.
LETTERS, SYMBOLS, PIECE = patterns("\U0010ffff")
NEAR_PIECE = patterns("\uffff")[2]
#: Characters read at once, symbols merged at once, pieces remembered (of at most so many characters).
CHUNK, BLOCK, CACHE, SHORT = 1 << 16, 4096, 1 << 18, 32
#: A pair is known by its rank and what it makes, in one number. Up to so many symbols are merged by going over them.
WIDE, NONE, FEW = 1 << 20, 1 << 60, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: Latin-1 where that is visible, else the next code point from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: Sequence[tuple[str, str]], sizes: dict[str, int]) -> int:
    """How many symbols after a token's end settle it, for a proper merge list; an improper one is a ValueError.

    A merge (u, v) is prevented by an earlier merge that takes v, or a symbol at the right edge of v while v is made,
    together with what follows; which in turn may be prevented by a still earlier one. ``reach`` of a merge is how far
    right of u such a chain goes. ``taken[s]`` is the most that the merges so far which start with s reach, and
    ``made[s]`` the same for the right edges within s, counting only merges that precede the one which joins the edge.
    """
    born, edge = {}, {}
    taken: dict[str, int] = {}
    made: dict[str, int] = {}
    most = 0
    size = dict(sizes)
    for rank, (u, v) in enumerate(merges):
        new = u + v
        if new in size or u not in size or v not in size:
            raise ValueError(f"not a proper merge list: merge {rank} makes {new!r} from {u!r} and {v!r}")
        reach = size[v] + max(0, taken.get(v, 0), made.get(v, 0))
        size[new], born[new], edge[new] = size[u] + size[v], rank, v
        made[new] = max(taken.get(v, 0), made.get(v, 0))
        taken[u] = max(taken.get(u, 0), reach)
        most = max(most, reach)
    return most


class Merges:
    """The merges of a piece: symbols in, token ids out."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]], suffix: str) -> None:
        symbols = byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + suffix] for s in symbols]
        self.lookahead = sufficient_lookahead(merges, {s: 1 for c in symbols for s in (c, c + suffix)})
        self.pairs = {(vocab[u], vocab[v]): rank * WIDE + vocab[u + v] for rank, (u, v) in enumerate(merges)}
        self.size: dict[int, int] = dict.fromkeys(self.inner + self.last, 1)
        for (u, v), pair in self.pairs.items():
            self.size[pair % WIDE] = self.size[u] + self.size[v]

    def short(self, data: bytes) -> list[int]:
        """The ids of a whole short piece."""
        inner = self.inner
        return self.merge([*[inner[b] for b in data[:-1]], self.last[data[-1]]])

    def merge(self, ids: list[int]) -> list[int]:
        """All of ``ids`` merged: always the pair of least rank, of equal ones the leftmost."""
        if len(ids) > FEW:
            return self._merge_many(ids)
        find = self.pairs.get
        ids, ranks = [*ids], [find(p, NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i, new = ranks.index(best), best & (WIDE - 1)
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = find((new, ids[i + 1]), NONE)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        """The same in n log n: pairs wait in a heap; those that are gone when their turn comes are passed over."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        ids = [*ids]
        while heap:
            pair, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get((ids[i], ids[j])) != pair:
                continue
            ids[i], ids[j] = new, _ = pair % WIDE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := pairs.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (pair, i))
            if (h := before[i]) >= 0 and (pair := pairs.get((ids[h], new))) is not None:
                heapq.heappush(heap, (pair, h))
        return [x for x in ids if x >= 0]


class Piece:
    """One piece that comes in parts. Holds at most a block, the lookahead and a token."""

    def __init__(self, merges: Merges, block: int) -> None:
        self.merges, self.block, self.held = merges, block, b""

    def feed(self, part: str) -> Iterator[int]:
        data, step = part.encode(), self.block + self.merges.lookahead
        for i in range(0, len(data), self.block):
            self.held += data[i : i + self.block]
            while len(self.held) > step:
                yield from self._settled()

    def _settled(self) -> Iterator[int]:
        # The last byte isn't known to end the piece, so all are inner ones.
        end, bound = 0, len(self.held) - self.merges.lookahead
        for t in self.merges.merge([self.merges.inner[b] for b in self.held]):
            if end + self.merges.size[t] > bound:
                break
            end += self.merges.size[t]
            yield t
        self.held = self.held[end:]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        return self.merges.merge([*(self.merges.inner[b] for b in self.held[:-1]), self.merges.last[self.held[-1]]])


def boundary(text: str) -> int:
    """The last place before which NFC never joins or reorders anything: that of a letter, digit, mark of punctuation
    or space that follows no composing rule (jamo do). 0 if there is none."""
    for i in range(len(text) - 1, 0, -1):
        c = text[i]
        if c < "\u0080" or (unicodedata.category(c)[0] in "LNPZ" and not ("ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿")):
            return i
    return 0


def lower(text: str) -> str:
    """Lower case by the character: a capital sigma at a word's end is an ordinary one."""
    return text.replace("Σ", "σ").lower()


class Tokenizer:
    """A vocabulary file and the transducer over it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, first = spec["model"], spec["pre_tokenizer"]
        fits = (
            model["type"] == "BPE"
            and model["end_of_word_suffix"]
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZERS}
            and first["type"] == "Sequence"
            and [p["type"] for p in first["pretokenizers"]] == ["Split", "ByteLevel"]
            and (first["pretokenizers"][0]["pattern"], first["pretokenizers"][0]["behavior"], first["pretokenizers"][0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not fits:
            raise ValueError(f"{path} isn't a BPE vocabulary with word ends, lower case and the usual pieces")
        self.merges = Merges(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.longest = max(map(len, self.specials), default=1)
        self.tokens = {i: t for t, i in (model["vocab"] | self.specials).items()}
        self.joint = " " if spec["decoder"] is None else ""
        self.known: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: str) -> Sequence[int]:
        """The ids of a whole piece; short ones are remembered, up to a number."""
        if len(piece) > SHORT:
            part = Piece(self.merges, BLOCK)
            return [*part.feed(piece), *part.finish()]
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            ids = self.known[piece] = tuple(self.merges.short(piece.encode()))
        return ids

    def segments(self, chunks: Iterable[str]) -> Iterator[tuple[str, int | None]]:
        """(text before, special token or None): splits at special tokens, wherever the chunks are cut."""
        held = ""
        for chunk in chunks:
            held, at = held + chunk, 0
            for m in self.special.finditer(held):
                yield held[at : m.start()], self.specials[m.group()]
                at = m.end()
            rest = max(at, len(held) - self.longest + 1)
            yield held[at:rest], None
            held = held[rest:]
        yield held, None

    def normal(self, parts: Iterable[tuple[str, int | None]]) -> Iterator[tuple[str, int | None]]:
        """Normalised parts, cut where normalisation can't reach across."""
        held = ""
        for text, token in parts:
            held += text
            at = len(held) if token is not None else boundary(held)
            yield lower(unicodedata.normalize("NFC", held[:at])), token
            held = held[at:]
        yield lower(unicodedata.normalize("NFC", held)), None

    def stream(self, chunks: Iterable[str], block: int = BLOCK) -> Iterator[int]:
        """Ids of the text that ``chunks`` make up, as soon as they are final.

        ``held`` is what can't be told apart yet (an apostrophe that may start a contraction); ``piece`` is a run of
        letters or symbols that the text so far ends with, and ``run`` the pattern that it goes on with.
        """
        held, piece, run = "", None, None

        def closing() -> Iterator[int]:
            nonlocal piece
            if piece is not None:
                yield from piece.finish()
                piece = None

        for part, token in self._ended(self.normal(self.segments(chunks))):
            text, at = held + part, 0
            if piece is not None and text:
                m = run.match(text)
                at = m.end() if m else 0
                yield from piece.feed(text[:at])
                if at < len(text):
                    yield from closing()
            held, end = "", len(text)
            for m in PIECE.finditer(text, at):
                if token is None and m.group() == "'" and end - m.start() < 3:
                    held = text[m.start() :]
                    break
                rule = None if token is not None or m.end() < end else LETTERS if LETTERS.match(m.group()) else SYMBOLS if SYMBOLS.fullmatch(m.group()) else None
                if rule is None:
                    yield from self.whole(m.group())
                else:  # it may go on
                    piece, run = Piece(self.merges, block), rule
                    yield from piece.feed(m.group())
            if token is not None:
                yield from closing()
                if token >= 0:
                    yield token

    @staticmethod
    def _ended(parts: Iterable[tuple[str, int | None]]) -> Iterator[tuple[str, int | None]]:
        """The same, and an end (-1) that closes what is open."""
        yield from parts
        yield "", -1

    def encode(self, text: str) -> list[int]:
        if len(text) > CHUNK or self.special.search(text):
            return list(self.stream(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)))
        text, known = lower(unicodedata.normalize("NFC", text)), self.known
        pieces = (PIECE if ASTRAL.search(text) else NEAR_PIECE).findall(text)
        return [*itertools.chain.from_iterable([known.get(p) or self.whole(p) for p in pieces])]


class Decoder:
    """Bytes to text, as they come: a state machine that holds the bytes of one unfinished character. What isn't UTF-8
    becomes U+FFFD. ``joint`` stands between tokens where the file names no decoder, as the vocabulary's own strings
    are then the text."""

    def __init__(self, tokens: dict[int, str], joint: str) -> None:
        back = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        self.parts = {i: t.encode() if joint else b"".join(back.get(c, c.encode()) for c in t) for i, t in tokens.items()}
        self.joint, self.machine, self.started = joint, codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Sequence[int]) -> str:
        """The text that is certain after ``ids``. An id that isn't in the vocabulary adds nothing."""
        try:
            parts = [*map(self.parts.__getitem__, ids)]
        except KeyError:
            parts = [self.parts[i] for i in ids if i in self.parts]
        if not parts:
            return ""
        text = (self.joint.encode() if self.started else b"") + self.joint.encode().join(parts)
        self.started = True
        return self.machine.decode(text)

    def finish(self) -> str:
        text, self.started = self.machine.decode(b"", True), False
        return text


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, read once a worker."""
    return Tokenizer(path)


@functools.lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    of = tokenizer(path)
    return Decoder(of.tokens, of.joint)


#: Rows that are worked on at once: what is held of a batch besides its texts.
ROWS = 256


def _with(df: DataFrame, added: dict[str, tuple[pa.DataType, str]], of: str, make) -> DataFrame:
    """``df`` with columns made from ``of`` by ``make``, a few rows at a time; columns of those names are replaced."""
    kept = [c for c in df.columns if c not in added]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(c, StructType.fromDDL(f"x {kind}")["x"].dataType) for c, (_, kind) in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                made = make(part.column(part.schema.get_field_index("_of")))
                arrays = [pa.array(x, kind) for x, (kind, _) in zip(made, added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*part.schema.names[:-1], *added])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{of}`").alias("_of")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with a column ``ids`` of the tokens of the whole text, special tokens inside a text included and none
    added; with ``decoded``, also a column of what those tokens decode to, so that ids needn't be moved for it. ``path``
    is the vocabulary file's place on every executor.

    Defined cases: a null, empty or blank text has no tokens; repeated rows get the same ones; a text of any length is
    read in chunks, and a piece of any length is merged in blocks; an empty table stays empty; existing columns of the
    names are replaced, others are left alone.
    """

    def make(texts: pa.Array) -> Iterator[list]:
        of = tokenizer(path)
        found = [np.array(of.encode(t) if t else [], np.int32) for t in texts.to_pylist()]
        yield found
        if decoded:
            yield [_text(decoder(path), x) for x in found]

    kinds = {ids: (pa.list_(pa.int32()), "array<int>")} | ({decoded: (pa.string(), "string")} if decoded else {})
    return _with(df, kinds, text, make)


def _text(of: Decoder, ids: np.ndarray) -> str:
    return of.feed(ids.tolist()) + of.finish() if len(ids) else ""


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its tokens, special ones included. Null or no ids give an empty text, null ids inside
    and ids that the vocabulary lacks add nothing; otherwise as ``encode``."""

    def make(lists: pa.Array) -> Iterator[list]:
        of = decoder(path)
        yield [_text(of, np.array([i for i in x if i is not None], np.int64)) if x else "" for x in lists.to_pylist()]

    return _with(df, {text: (pa.string(), "string")}, ids, make)
