"""Alignment of two tokenizers over the same texts, by owner arrays.

Each byte of a text is owned by one token of A and one of B: ``np.repeat`` of the tokens' places by their lengths gives
the owner of every byte. Where the pair of owners differs from that of the byte before, a new link (an overlap of an A
token and a B token) begins; where both owners change at once, A and B both end a token, and a group ends.

How often a pair of ids is linked in the whole corpus is counted in chunks: a chunk of texts lists its distinct pairs
once, in order, and its documents hold places in that list. Only the lists are summed and joined over the corpus, so
what is shuffled for a pair is one row a chunk, and each chunk gets the counts of its own pairs back.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import cut

# Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a chunk, but for a longer text, which is one.
CHUNK = 8 << 20


class Vocabulary:
    """The bytes of each token and how a text is encoded, special tokens' strings as plain text."""

    def __init__(self, pieces: Sequence[bytes], encode) -> None:
        self.pieces, self.encode = list(pieces), encode
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def spell(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> Vocabulary:
    """A: a byte-level BPE file, whose ids are its merge ranks; read once a worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, back = spec["model"]["vocab"], {s: b for b, s in enumerate(byte_symbols())}
    first = spec["pre_tokenizer"]
    if spec["normalizer"] or first["type"] != "ByteLevel" or first["add_prefix_space"] or not first["use_regex"]:
        raise ValueError(f"{path} isn't a byte-level vocabulary without normalisation")
    if any(vocab["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(spec["model"]["merges"])):
        raise ValueError(f"the ids of {path} aren't its merge ranks")
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token) and i < 256 + len(spec["model"]["merges"])}
    coder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(sorted(ranks, key=ranks.__getitem__), lambda text: coder.encode_to_numpy(text, disallowed_special=()).astype(np.int32))


@functools.lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> Vocabulary:
    """B: a sentencepiece model, which puts a space before the text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
    return Vocabulary(pieces, lambda text: model.encode(text, num_threads=1))


def owners(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A places and B places of the links, tokens of A and of B before each group's end), from the tokens' lengths in
    bytes, which have the same sum."""
    a, b = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.concatenate([[0], np.flatnonzero(a_new | b_new) + 1])
    cuts = np.flatnonzero(a_new & b_new)
    return a[at], b[at], np.append(a[cuts] + 1, len(a_sizes)), np.append(b[cuts] + 1, len(b_sizes))


class Aligner:
    """Two vocabularies and the tables that groups are written with: an A id ends in a comma or its group's bar, a B id
    in a comma or its group's semicolon."""

    def __init__(self, a: Vocabulary, b: Vocabulary) -> None:
        self.a, self.b = a, b
        self.spelled = np.array([f"{i}{end}" for v, ends in ((a, ",|"), (b, ",;")) for end in ends for i in range(len(v.pieces))], object)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of A for a space and the text, and of B for the text; none for a null or empty text, or where either
        doesn't spell the space and the text."""
        if text:
            a, b, whole = self.a.encode(" " + text), self.b.encode(text), b" " + text.encode()
            # A's tokens are cut from the bytes themselves, so their lengths tell; B's may be normalised.
            if self.a.sizes[a].sum() == len(whole) and self.b.spell(b) == whole:
                return a, np.array(b, np.int32)
        return np.zeros(0, np.int32), np.zeros(0, np.int32)

    def groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        shut_a, shut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        shut_a[a_ends - 1] = shut_b[b_ends - 1] = 1
        n, m = len(self.a.pieces), len(self.b.pieces)
        group = np.concatenate([2 * (np.cumsum(shut_a) - shut_a), 2 * (np.cumsum(shut_b) - shut_b) + 1])
        names = np.concatenate([a + n * shut_a, 2 * n + b + m * shut_b])[np.argsort(group, kind="stable")]
        return "".join(self.spelled[names].tolist())[:-1]


def pack(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each occurs, as compressed differences."""
    return zlib.compress(np.concatenate([np.diff(places, prepend=0), times]).astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


ALIGNED = "a_ids array<int>, b_ids array<int>, groups string, n_groups long, n_links long, chunk long, places binary, pairs array<long>, totals array<long>"


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: Sequence[str] = ("doc_id",), chunk: int = CHUNK) -> DataFrame:
    """A row a document with the columns ``keep``, its tokens, its groups as text and the number of groups and links;
    and a row a chunk, which alone has ``pairs``: the distinct linked pairs of ids of its documents (a times the size
    of B's vocabulary, plus b) and how often each occurs. ``places`` of a document are places in its chunk's list.

    Defined cases: a null or empty text, or one that A's or B's tokens don't spell after a space, has no tokens, groups
    or links; repeated rows are rows of their own; an empty table gives no rows. A chunk has consecutive rows of one
    task, so how documents are dealt decides what a chunk is, but nothing that is counted over all chunks.
    """
    kinds = dict(df.dtypes)
    hidden = {c: f"_keep{i}" for i, c in enumerate(keep)}
    schema = ", ".join(f"{hidden[c]} {kinds[c]}" for c in keep) + ", " + ALIGNED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Aligner(byte_vocabulary(path_a), piece_vocabulary(path_b))
        width, number = len(both.b.pieces), TaskContext.get().partitionId() << 32

        def rows(of: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
            out, linked = [], []
            for t in of["_text"]:
                a, b = both.tokens(t)
                if len(a):
                    at_a, at_b, a_ends, b_ends = owners(both.a.sizes[a], both.b.sizes[b])
                    linked.append(a[at_a].astype(np.int64) * width + b[at_b])
                    out.append((a, b, both.groups(a, b, a_ends, b_ends), len(a_ends), len(at_a)))
                else:
                    linked.append(a)
                    out.append((a, b, "", 0, 0))
            place, pairs = pd.factorize(np.concatenate(linked).astype(np.int64))
            totals = np.bincount(place, minlength=len(pairs))
            ends = np.cumsum([len(x) for x in linked])
            done = pd.DataFrame(out, columns=["a_ids", "b_ids", "groups", "n_groups", "n_links"])
            done["chunk"] = number
            done["places"] = [pack(*np.unique(place[i:j], return_counts=True)) for i, j in zip([0, *ends], ends, strict=False)]
            done["pairs"] = done["totals"] = None
            for c in hidden.values():
                done[c] = of[c].to_numpy()
            listed = dict.fromkeys(done.columns) | {"chunk": number, "pairs": pairs, "totals": totals}
            return done, pd.DataFrame([listed])

        for batch in batches:
            size = batch["_text"].str.len().fillna(0).to_numpy().cumsum()
            starts = np.flatnonzero(np.diff(size // chunk, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(batch)], strict=True):
                yield from rows(batch.iloc[i:j])
                number += 1

    found = df.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()), F.col(f"`{text}`").alias("_text")).mapInPandas(run, schema)
    return found.withColumnsRenamed({h: c for c, h in hidden.items()})


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) for every linked pair of ids: in how many links of all documents it is, and whether no other
    pair with its B id is in more. B ids are at most ``width``, so their maxima are broadcast."""
    listed = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).select("p.*")
    counts = cut(listed.groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("n")))
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The document rows of ``aligned`` with n_best (links whose pair is its B id's best) and count_sum (the counts of
    all links, summed), and the columns ``keep``. ``aligned`` is read twice: store it first.

    Documents meet their chunk's counts in one group, which is bounded by the chunk, whatever its documents hold.
    """
    listed = aligned.where("pairs IS NOT NULL").select("chunk", F.posexplode("pairs").alias("place", "pair"))
    scored = listed.join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    docs = aligned.where("pairs IS NULL").select("chunk", "places", F.struct(*keep).alias("kept"))
    kind = docs.schema["kept"].dataType.simpleString()

    def run(doc: pd.DataFrame, pair: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        n[pair["place"]], best[pair["place"]] = pair["n"], pair["best"]
        sums = [(int((best[at] * times).sum()), int((n[at] * times).sum())) for at, times in map(unpack, doc["places"])]
        return pd.DataFrame({"kept": doc["kept"], "n_best": [s[0] for s in sums], "count_sum": [s[1] for s in sums]})

    joined = docs.groupBy("chunk").cogroup(scored.groupBy("of")).applyInPandas(run, f"kept {kind}, n_best long, count_sum long")
    return joined.select("kept.*", "n_best", "count_sum")
