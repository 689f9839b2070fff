"""Members of tar archives by a list of wanted names, with damage as rows of its own."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.bloom import filtered_semi

#: Bytes of a tar block, and wanted names that a task looks for itself; more are looked up behind a Bloom filter.
BLOCK, MOST_WANTED = 512, 1_000_000
SCHEMA = "archive string, name string, content binary, gap string"


def unpacked(data: bytes) -> tuple[bytes, str | None]:
    """What a plain or gzipped archive holds, and why not all of it could be read."""
    out = bytearray()
    while data.startswith(b"\x1f\x8b"):
        stream = zlib.decompressobj(31)
        try:
            for i in range(0, len(data), 1 << 20):
                out += stream.decompress(data[i : i + (1 << 20)])
                if stream.eof:
                    data = stream.unused_data + data[i + (1 << 20) :]
                    break
            else:
                return bytes(out), "compressed data without end"
        except zlib.error as e:
            return bytes(out), str(e)
        if not data.strip(b"\0"):
            return bytes(out), None
    return (bytes(out), "what follows isn't compressed") if out else (data, None)


def is_header(data: bytes, at: int) -> bool:
    try:
        tarfile.TarInfo.frombuf(data[at : at + BLOCK], "utf-8", "surrogateescape")
    except tarfile.HeaderError:
        return False
    return True


def members(data: bytes, wanted: set[str] | None) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(name, content, None) of each wanted file, or of all, and (null, null, reason) for each damaged stretch, which is
    searched for the next header block by block."""
    data, lost = unpacked(data)
    at = 0
    while at < len(data):
        shift, why, seen = at, None, 0
        try:
            with tarfile.open(fileobj=io.BytesIO(data[at:]), mode="r:") as tar:
                for m in tar:
                    seen = m.offset_data + -(-m.size // BLOCK) * BLOCK if m.isreg() else m.offset_data
                    if m.isfile() and shift + m.offset_data + m.size > len(data):
                        raise tarfile.ReadError("a member is cut off")
                    if m.isfile() and (wanted is None or m.name in wanted):
                        yield m.name, tar.extractfile(m).read(), None
                seen = tar.offset
            rest = data[shift + seen : shift + seen + BLOCK]
            # tarfile takes a header that it can't read for the end; the end is a block of zeros.
            why = None if len(rest) == BLOCK and not rest.strip(b"\0") else "no end of archive" if len(rest) < BLOCK else "damaged header"
        except (tarfile.TarError, ValueError, EOFError) as e:
            why = str(e)
        if why is None:
            break
        yield None, None, why
        at = next((x for x in range(shift + max(seen, BLOCK), len(data) - BLOCK + 1, BLOCK) if data[x : x + BLOCK].strip(b"\0") and is_header(data, x)), len(data))
    if lost:
        yield None, None, lost


def members_of(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """(archive, name, content, gap) of archives (path, content): a row for each file whose name is in ``wanted`` (column
    ``name``), and one for each damaged stretch, with its reason as ``gap`` and no name.

    A member that repeats comes each time; null names are wanted by nobody; an empty archive has no rows. Archives are
    read one at a time, each in a cell of at most 2 GB.
    """
    names = wanted.select("name").where("name IS NOT NULL").distinct()
    few = names.limit(MOST_WANTED + 1).collect()
    known = {r["name"] for r in few} if len(few) <= MOST_WANTED else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                for row in members(bytes(content or b""), known):
                    yield pd.DataFrame([(path, *row)], columns=["archive", "name", "content", "gap"])

    found = archives.select("path", "content").mapInPandas(run, SCHEMA)
    if known is not None:
        return found
    return filtered_semi(found.where("name IS NOT NULL"), names, ["name"]).unionByName(found.where("name IS NULL"))


def tar_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``members_of`` the tar archives at ``path``."""
    return members_of(spark.read.format("binaryFile").load(path), wanted)


def packed(df: DataFrame, archive: str, name: str, content: str) -> DataFrame:
    """(path, content): a tar archive for each value of ``archive``, of rows in the order of ``name``; for groups of
    bounded size, as an archive is one cell."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for n, c in sorted(zip(g["_name"], g["_content"], strict=True)):
                info = tarfile.TarInfo(n)
                info.size = len(c)
                tar.addfile(info, io.BytesIO(c))
        return pd.DataFrame({"path": [g["_path"].iloc[0]], "content": [out.getvalue()]})

    rows = df.select(F.col(archive).cast("string").alias("_path"), F.col(name).cast("string").alias("_name"), F.col(content).cast("binary").alias("_content")).na.drop()
    return rows.groupBy("_path").applyInPandas(run, "path string, content binary")
