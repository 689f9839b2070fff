"""S7 for archives of any size: an index of members by a walk over headers, and contents by ranges of bytes.

The index is a table, so a list of wanted names is a semi join on it and what isn't wanted is never read; contents are
read in pieces by as many tasks as their bytes ask for, also those of one archive or one member. Files are opened by
their place (``pyarrow.fs``), so archives must lie where all executors reach them.
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.bloom import filtered_semi
from gaugeframe.operators.tables import cut

from .archives import BLOCK, is_header

#: Bytes of a piece of a member, which is a cell; of a stretch of an archive that a task reads; and of a read in search of
#: a header.
PIECE, SPAN, SEARCH = 1 << 26, 1 << 27, 1 << 20
INDEX = "archive string, name string, start long, size long, gap string"
FOUND = "archive string, name string, size long, piece long, content binary, gap string"


def located(place: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a place as Spark names it."""
    place = re.sub(r"^file:/+", "file:///", place)
    return fs.FileSystem.from_uri(place)


def _next_header(f: BinaryIO, at: int, size: int) -> int:
    """The first place from ``at`` on, by blocks, that holds a valid header; ``size`` if there is none."""
    while at + BLOCK <= size:
        f.seek(at)
        data = f.read(min(SEARCH, size - at))
        for x in range(0, len(data) - BLOCK + 1, BLOCK):
            if data[x : x + BLOCK].strip(b"\0") and is_header(data, x):
                return at + x
        at += max(BLOCK, len(data) // BLOCK * BLOCK)
    return size


def walk(f: BinaryIO, size: int) -> Iterator[tuple[str | None, int, int, str | None]]:
    """(name, start, size, None) of each file in an archive, and (null, start, size, reason) of each damaged stretch, up to
    the next valid header. Only headers are read; what is known of a member is forgotten at once."""
    at = 0
    while at < size:
        seen, why = at, None
        try:
            f.seek(at)
            with tarfile.open(fileobj=f, mode="r:") as tar:
                while (m := tar.next()) is not None:
                    tar.members = []
                    if m.isreg() and m.offset_data + m.size > size:
                        yield None, m.offset, size - m.offset, "a member is cut off"  # its header's sum is right, so is its size
                        return
                    seen = m.offset_data + (-(-m.size // BLOCK) * BLOCK if m.isreg() else 0)
                    if m.issparse():
                        yield None, m.offset, seen - m.offset, f"a sparse file: {m.name}"
                    elif m.isfile():
                        yield m.name, m.offset_data, m.size, None
                    seen = tar.offset
                seen = max(seen, tar.offset)
            f.seek(seen)
            rest = f.read(BLOCK)
            # tarfile takes a header that it can't read for the end; the end is a block of zeros.
            why = None if len(rest) == BLOCK and not rest.strip(b"\0") else "no end of archive" if len(rest) < BLOCK else "damaged header"
        except (tarfile.TarError, ValueError, EOFError) as e:
            why = str(e)
        if why is None:
            return
        after = _next_header(f, max(seen, at + BLOCK), size)
        yield None, min(seen, size), max(0, after - seen), why
        at = after


def member_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, start, size, gap) of the tar archives at ``path``: a row for each file with the place of its bytes,
    and one for each damaged stretch, with its reason as ``gap`` and no name.

    A task walks an archive from header to header and reads nothing else, so its memory doesn't grow. A name that repeats
    comes each time; links and folders are no files; an empty archive has no rows. A compressed archive can't be entered
    in the middle: it is one gap here, and for ``archives.tar_members``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for place, length in zip(b["path"], b["length"], strict=True):
                system, at = located(place)
                with system.open_input_file(at) as f:
                    packed = f.read(2) == b"\x1f\x8b"
                    rows = [(None, 0, length, "a compressed archive")] if packed else walk(f, length)
                    held = []
                    for row in rows:
                        held.append((place, *row))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=["archive", "name", "start", "size", "gap"])
                            held = []
                    yield pd.DataFrame(held, columns=["archive", "name", "start", "size", "gap"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    # A walk is long and its row small: archives are spread one by one.
    return files.repartition("path").mapInPandas(run, INDEX)


def contents(index: DataFrame) -> DataFrame:
    """(archive, name, size, piece, content, gap) of the rows of an index, whole or filtered: contents of ``PIECE`` bytes
    and less, numbered from 0; an empty file has one empty piece, and gaps come as they are. Neighbours within ``SPAN``
    bytes are read by one task in the order of their bytes."""
    piece, span = F.lit(PIECE), F.lit(SPAN)
    files = index.where("gap IS NULL").select("archive", "name", "size", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / piece))).alias("piece"))
    files = files.withColumn("start", F.col("start") + F.col("piece") * piece).withColumn("span", F.floor(F.col("start") / span))
    files = files.repartition("archive", "span").sortWithinPartitions("archive", "start").drop("span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        names = ["archive", "name", "size", "piece", "content", "gap"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            held, held_bytes = [], 0
            for r in b.to_pylist():
                if r["archive"] != opened:
                    if f is not None:
                        f.close()
                    system, at = located(r["archive"])
                    opened, f = r["archive"], system.open_input_file(at)
                want = min(PIECE, r["size"] - r["piece"] * PIECE)
                f.seek(r["start"])
                data = f.read(want)
                if len(data) != want:
                    raise OSError(f"{opened} has become shorter since it was indexed")
                held.append((r["archive"], r["name"], r["size"], r["piece"], data, None))
                held_bytes += want
                if held_bytes >= PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                    held, held_bytes = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        if f is not None:
            f.close()

    none = lambda kind: F.lit(None).cast(kind)
    gaps = index.where("gap IS NOT NULL").select("archive", "name", "size", none("long").alias("piece"), none("binary").alias("content"), "gap")
    return files.mapInArrow(run, FOUND).unionByName(gaps)


def wanted_contents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``contents`` of the files whose name is in ``wanted`` (column ``name``), of any length, and all gaps. The index is
    written once, as names and gaps are both asked of it; null names are wanted by nobody."""
    index = cut(member_index(spark, path))
    names = wanted.select("name").where("name IS NOT NULL").distinct()
    return contents(filtered_semi(index.where("name IS NOT NULL"), names, ["name"]).unionByName(index.where("name IS NULL")))


def write_archives(df: DataFrame, archive: Column, name: Column, content: Column, folder: str) -> DataFrame:
    """Write a tar archive below ``folder`` for each value of ``archive``, members by name and content, and return a
    receipt (archive, members, bytes) of each. Rows are streamed, so an archive may be larger than memory; a file takes
    its name when it is whole, so a task that is run again leaves no double. Rows without any of the three are left out."""
    rows = df.select(archive.cast("string").alias("archive"), name.cast("string").alias("name"), content.cast("binary").alias("content")).na.drop()
    rows = rows.repartition("archive").sortWithinPartitions("archive", "name", "content")
    base = folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = located(base if ":" in base.split("/")[0] else f"file://{base}")
        at, tar, out, part, n = None, None, None, None, 0

        def close() -> pd.DataFrame:
            tar.close()
            size = out.tell()
            out.close()
            system.move(part, f"{root}/{at}")
            return pd.DataFrame([(at, n, size)], columns=["archive", "members", "bytes"])

        system.create_dir(root, recursive=True)
        for b in batches:
            for a, m, c in zip(b["archive"], b["name"], b["content"], strict=True):
                if a != at:
                    if tar is not None:
                        yield close()
                    at, part, n = a, f"{root}/_{uuid.uuid4().hex}", 0  # Spark's readers pass over names that begin so
                    out = system.open_output_stream(part)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(m)
                info.size, n = len(c), n + 1
                tar.addfile(info, io.BytesIO(c))
        if tar is not None:
            yield close()

    return cut(rows.mapInPandas(run, "archive string, members long, bytes long"))
