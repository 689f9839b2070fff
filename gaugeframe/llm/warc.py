"""WARC: a writer for page records with revisits, and a salvage reader.

The writer makes each record a row of text and leaves the files to Spark's own text writer, with the blank lines
that end a record as the line separator: files appear by task commit, on any file system that Spark writes to, and a
task that is lost and run again leaves no second copy. Records are written by classes of size, a file of a class
holding fewer records the larger they are, so that a file has ``FILE_BYTES`` or one record.

The reader takes whole files, plain or with gzip members, of up to the 2 GB that a cell can hold (Spark refuses a
larger file with an error). A record whose version line, header, length, end or digest fails is not trusted: the
reader looks for the next version line or member that starts a valid record, goes on from there, and logs the gap in
bytes. It takes time in proportion to the file: what it searches for is searched for once, members are inflated piece
by piece, and headers have a greatest length.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators.tables import forget_on_exit

from .common import cut, scratch

CRLF, END = "\r\n", "\r\n\r\n"
VERSION, MEMBER = re.compile(rb"WARC/1\.[01]\r\n"), b"\x1f\x8b\x08"
#: Bytes of a gzip member that are read at once, of a header at most, and members inside members at most.
PIECE, HEADER_MOST, DEEPEST = 1 << 16, 1 << 20, 16
#: Bytes of a file to aim for, records of it at most, and payloads that are worth a revisit at least.
FILE_BYTES, FILE_RECORDS, LEAST = 128 << 20, 2000, 100
#: Revisits up to which their list is broadcast (about 90 bytes each), so that payloads stay where they are; a longer
#: list is joined by shuffle.
MOST_REVISITS = 500_000


def _plain(value: Column) -> Column:
    """A header's value on one line: control characters as spaces."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, of) of each page that revisits an earlier one. Only ids and digests are moved; a hot digest's
    rows are split by the adaptive skew join, as the side of first pages has one row a digest."""
    body = F.coalesce("html", F.lit(""))
    sums = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")).where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    first = sums.groupBy("digest").agg(F.min("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = cut(sums.join(first, "digest").where(F.col("page_id") != F.col("of")).select("page_id", "digest", "of").distinct())
    return F.broadcast(found) if found.count() <= MOST_REVISITS else found


def _id(page: Column) -> Column:
    """A page's id in a header: any text, percent-encoded; integers as they are."""
    return F.url_encode(page.cast("string"))


def records(pages: DataFrame, least: int = LEAST, known: DataFrame | None = None) -> DataFrame:
    """(page_id, record): one WARC record a page, without its last blank lines. ``known``: the revisits, if they were
    looked for already.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id is the response and the
    others revisit it; smaller payloads are all responses, and so are pages without an id. Pages that share an id are
    each written.
    """
    body = F.coalesce("html", F.lit(""))
    page = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    page = page.join(revisits(pages, least) if known is None else known, ["page_id", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(F.col("of").isNull(), F.concat(http, F.col("body"))).otherwise(http)
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), _id(F.col("of")), F.lit(">\r\n")
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("of").isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(_id(F.col("page_id")), F.lit("")),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), _plain(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF), F.coalesce(revisit, F.lit("")),
        F.lit("WARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block,
    )
    return page.select("page_id", head.alias("record"))


def size_class(pages: DataFrame) -> Column:
    """How often a record of 64 kB must grow fourfold to hold the page."""
    bytes_ = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, bytes_ / (FILE_BYTES // FILE_RECORDS)))).cast("int")


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write the pages' records as plain WARC files below ``path``, each class of sizes in a folder of its own."""
    known = revisits(pages, least)
    classes = [r["size"] for r in pages.select(size_class(pages).alias("size")).distinct().collect()]
    for size in sorted(classes) or [0]:
        of_size = records(pages.where(size_class(pages) == size), least, known)
        of_size.select("record").write.option("lineSep", END).option("maxRecordsPerFile", max(1, FILE_RECORDS >> (2 * size))).text(f"{path}/size={size}")


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in raw.split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def parse(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that starts at ``at`` and where the next one starts, or what is wrong with it."""
    m = VERSION.match(data, at)
    if not m:
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end(), m.end() + HEADER_MOST)
    if end < 0:
        return "header without end"
    head = _headers(data[m.end() : end])
    if not re.fullmatch(r"\d{1,15}", head.get("content-length", "")):
        return "no content length"
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "record doesn't end where its length says"
    block = data[start:stop]
    if head.get("warc-block-digest", "").startswith("sha256:") and hashlib.sha256(block).hexdigest() != head["warc-block-digest"][7:]:
        return "block digest differs"
    payload, length = block, len(block)
    if "application/http" in head.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if head.get("warc-type") == "revisit" and (said := _headers(http).get("content-length")) is not None:
            if not re.fullmatch(r"\d{1,15}", said):
                return "no payload length"
            length = int(said)
    if head.get("warc-type") != "revisit" and head.get("warc-payload-digest", "").startswith("sha256:") and hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"][7:]:
        return "payload digest differs"
    return {"head": head, "payload": payload, "payload_bytes": length}, stop + 4


def _up_to_error(member, piece: bytes) -> bytes:
    """What ``member`` makes of ``piece`` before the error in it."""
    probe, i = member.copy(), 0
    with contextlib.suppress(zlib.error):
        for i in range(len(piece)):
            probe.decompress(piece[i : i + 1])
    out, rest = member.decompress(piece[:i]), piece[i : i + 1]
    with contextlib.suppress(zlib.error):
        while got := member.decompress(rest, 1):
            out, rest = out + got, member.unconsumed_tail
    return out


def inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, as far as it can be read, where it ends, and why not all could be read."""
    member, out, to = zlib.decompressobj(31), bytearray(), at
    while to < len(data) and not member.eof:
        piece, before = data[to : to + PIECE], member.copy()
        try:
            out += member.decompress(piece)
        except zlib.error as e:
            return bytes(out + _up_to_error(before, piece)), to, str(e)
        to += len(piece)
    return bytes(out), to - len(member.unused_data), None if member.eof else "member without end"


def _used(data: bytes, at: int, size: int) -> int:
    """Where in ``data`` the first ``size`` bytes of what the member at ``at`` holds end."""
    member, to = zlib.decompressobj(31), at
    while piece := data[to : to + PIECE]:
        before = member.copy()
        with contextlib.suppress(zlib.error):
            if (n := len(member.decompress(piece))) < size:
                size, to = size - n, to + len(piece)
                continue
        with contextlib.suppress(zlib.error):
            while size > 0 and to < len(data):
                size, to = size - len(before.decompress(data[to : to + 1])), to + 1
        break
    return to


class _Next:
    """Where a pattern is found next, or the end of the data; it is searched for again only from beyond the last place."""

    def __init__(self, find: Callable[[int], int]) -> None:
        self.find, self.at = find, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            self.at = self.find(start)
        return self.at


def salvage(data: bytes, depth: int = 0) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(from, to, record, None) for each record, and (from, to, None, reason) for each gap, in the order of the file.

    What a gzip member holds, records and gaps, has the member's place. Of a member that can't be read to its end the
    records before the error count, also one that has the member to itself: each is whole and has passed its own
    checks. Their place ends with the last of them, what follows is a gap, and the search goes on from there. Members
    inside members are opened up to ``DEEPEST`` deep; what lies deeper is a gap.
    """
    at, gap, why = 0, None, ""
    version = _Next(lambda start: m.start() if (m := VERSION.search(data, start)) else len(data))
    member = _Next(lambda start: z if (z := data.find(MEMBER, start)) >= 0 else len(data))
    while at < len(data):
        got: list[tuple[dict | None, str | None]] = []
        stop, error = at, None
        if data.startswith(MEMBER, at) and depth < DEEPEST:
            inner, stop, error = inflate(data, at)
            found = list(salvage(inner, depth + 1))
            reason = error or next((x[3] for x in found if x[3]), "empty member")
            if error:
                found = found[: max((i + 1 for i, x in enumerate(found) if x[2]), default=0)]
                stop = _used(data, at, found[-1][1]) if found else at
            got = [x[2:] for x in found] if any(x[2] for x in found) else []
        else:
            reason = parse(data, at)
            if not isinstance(reason, str):
                got, stop = [(reason[0], None)], reason[1]
        if got:
            if gap is not None and gap < at:
                yield gap, at, None, why
            gap = None
            for x in got:
                yield at, stop, *x
        elif gap is None:
            gap, why = at, str(reason)
        if stop > at and not error:  # a record, or a member read to its end: nothing to look for inside
            at = stop
            continue
        if got:
            gap, why, start = stop, str(error), stop
        else:
            start = at + 1
        at = min(version(start), member(start))
    if gap is not None and gap < len(data):
        yield gap, len(data), None, why


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for every record and every gap below ``path``: file, from_byte, to_byte, record_type, record_id, url,
    payload_bytes, payload_digest, refers_to, payload (if asked for) and gap (the reason, null for records).

    Defined cases: an empty file has no rows; a file that holds no valid record is one gap; records that repeat are
    each a row. Files come to Python in batches of about 64 MB, or one by one where they are larger.
    """
    names = ["file", "from_byte", "to_byte", "record_type", "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload", "gap"]

    def row(file: str, a: int, b: int, x: dict | None, why: str | None) -> tuple:
        if x is None:
            return file, a, b, None, None, None, None, None, None, None, why
        h = x["head"]
        digest = h.get("warc-payload-digest", "")[7:] if h.get("warc-type") == "revisit" else hashlib.sha256(x["payload"]).hexdigest()
        return file, a, b, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), x["payload_bytes"], digest, h.get("warc-refers-to"), x["payload"] if payloads else None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                out = []
                for x in salvage(bytes(data)):
                    out.append(row(file, *x))
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64"})

    schema = "file string, from_byte long, to_byte long, record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, gap string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def page_of(uri: Column, kind: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(uri, "<urn:page:([^>]*)>", 1), F.lit(""))).cast(kind)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to a new place in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to. A gap comes back as a row without a record type.

    Defined cases: a null html is an empty payload; a null url is empty; a null page_id comes back as null and an empty
    text as null; pages that share an id or repeat each other come back as often as they come, those that share an id
    and a payload all as its response or all as its revisits; a payload may be as long as a cell; other columns are
    left out; an empty table gives an empty result.
    """
    path = scratch(pages.sparkSession)
    write(pages, path, least)
    forget_on_exit(pages.sparkSession, path)
    kind = dict(pages.dtypes)["page_id"]
    found = read(pages.sparkSession, path)
    return cut(found.select(page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to"), kind).alias("refers_to")))
