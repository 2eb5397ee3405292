"""WARC archives of pages: written through Spark's own file commit, read back by a reader that salvages damaged files.

General operator: the match records hold no web pages of their own; any ``page_id, url, html`` rows work, such as saved
match reports.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_PAGE = "urn:x-page:"
_CHUNK = 1 << 15
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None, date: str) -> bytes:
    """One record as a gzip member. A page without id or url gets a stand-in address."""
    own = f"<{_PAGE}{'' if page is None else page}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or own[1:-1]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {own}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers}>", f"WARC-Profile: {_PROFILE}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    packed = packer.compress(data) + packer.flush()
    if packed[-1]:  # the last byte of a length of 16 MB and more; an empty member follows, which ends in a zero
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed += packer.compress(b"") + packer.flush()
    return packed


def page_roles(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a page of smaller id has too; no other pages.

    Only ids and digests move. A payload of very many pages is one row of each task when the least id is found, and its
    rows meet that one row in a join that the adaptive planner can split.
    """
    small = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where(
        "_n > 1 and refers_to is not null").drop("_n")
    return small.join(first, "digest").where("page_id is null or page_id <> refers_to").distinct()


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
               date: str = "1970-01-01T00:00:00Z", file_bytes: int = 32 << 20) -> None:
    """A record for each page, each its own gzip member, in files of about ``file_bytes`` bytes under ``path``.

    A file ends with the record that reaches the size, so only a single record can make it much longer.

    Of pages with equal payloads that of the smallest id is a response and the others are revisits of it, without
    payload. A null payload is empty. Pages without id are revisits where a page with an id has their payload, else
    responses; repeated rows of the smallest id are all responses. Other columns are not read; an empty table writes no
    record. The pages are shuffled once, by id, to meet their roles.
    """
    own = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                       F.col(html).cast("string").alias("html"))
    roles = page_roles(own).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    raw = F.coalesce("html", F.lit("")).cast("binary")
    rows = own.withColumn("digest", F.sha1(raw)).join(
        roles, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), raw).alias("payload"),
                       F.octet_length(raw).cast("bigint").alias("size"), "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                for r in batch.slice(start, 100).to_pylist():
                    members.append(_record(r["page_id"], r["url"], r["payload"] or b"", r["size"],
                                           base64.b32encode(bytes.fromhex(r["digest"])).decode(), r["refers_to"], date))
                    held += len(members[-1])
                    if held >= file_bytes:
                        yield _file(members)
                        members, held = [], 0
        if members:
            yield _file(members)

    # a row is a file; the text writer adds its last byte, the zero that ends its last member, as the line end
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", 1).text(path)


def _file(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])


@dataclass
class Piece:
    """What the salvage reader finds at ``offset``: a record (with ``headers``) or a gap that it could not read.

    ``inner`` is where the piece begins in what the gzip member at ``offset`` inflates to (``inner_length`` bytes). A gap
    has a ``reason``; a record has one where its member's bytes are corrupt elsewhere, so that nothing but its own digest
    vouches for it.
    """

    offset: int
    length: int
    reason: str = ""
    headers: dict[str, str] | None = None
    block: bytes = b""
    inner: int | None = None
    inner_length: int | None = None


def _parse(data: bytes, at: int) -> tuple[Piece, int]:
    """The record that begins at ``at``, checked, and where it ends. Raises ``ValueError`` saying what is wrong."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without colon")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= headers.keys():
        raise ValueError("mandatory header missing")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = data[start:stop]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest32(block):
        raise ValueError("block digest differs")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", "").startswith("sha1:"):
        if headers["warc-payload-digest"][5:] != digest32(block.partition(b"\r\n\r\n")[2]):
            raise ValueError("payload digest differs")
    return Piece(at, stop + 4 - at, "", headers, block), stop + 4


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` inflates to, where it ends, and what is wrong with it. A member that fails gives what
    came before the error."""
    unpack, out, view = zlib.decompressobj(31), [], memoryview(data)
    while not unpack.eof:
        some = view[at:at + _CHUNK]
        if not some:
            return b"".join(out), at, "member does not end"
        before = unpack.copy()
        try:
            out.append(unpack.decompress(some))
            at += len(some)
        except zlib.error as wrong:
            try:
                for i in range(len(some)):
                    out.append(before.decompress(some[i:i + 1]))
                    at += 1
            except zlib.error:
                pass
            return b"".join(out), at, str(wrong)
    return b"".join(out), at - len(unpack.unused_data), ""


def _plain(data: bytes) -> list[Piece]:
    """All records of plain bytes in order, and a gap for each stretch between them."""
    found: list[Piece] = []
    at, bad, reason = 0, -1, ""
    while at < len(data):
        try:
            piece, end = _parse(data, at)
        except ValueError as wrong:
            if bad < 0:
                bad, reason = at, str(wrong)
            version = _VERSION.search(data, at + 1)
            at = version.start() if version else len(data)
            continue
        if bad >= 0:
            found.append(Piece(bad, at - bad, reason))
            bad = -1
        found.append(piece)
        at = end
    if bad >= 0:
        found.append(Piece(bad, len(data) - bad, reason))
    return found


def salvage(data: bytes) -> Iterator[Piece]:
    """All records of an archive in order, gzip members or plain, and a gap for each stretch of bytes between them.

    A record must have a version line, its mandatory headers, its length and its digests. After a failed check the search
    goes on at the next place where a member or a version line begins *and* checks out; everything before it is one gap,
    with the first reason. What a member inflates to is searched in the same way, so one that holds many records loses
    only those that fail, as gaps with inner offsets. Of a member that is cut off or corrupt the records in what was
    inflated before the error are given, then the member is a gap with the error; where it is corrupt, they must have a
    block digest, and carry the error as their reason. Where that is one record and nothing else, it is the member, and
    only the gap is given.
    """
    at, bad, reason = 0, -1, ""
    given, until = set(), 0  # what a broken member gave, and the end of its bytes: stored blocks hold records as they are
    while at < len(data):
        wrong, end, pieces = "", at, []
        if data.startswith(_MEMBER, at):
            inner, end, wrong = _inflated(data, at)
            pieces = [Piece(at, end - at, p.reason, p.headers, p.block, p.offset, p.length) for p in _plain(inner)]
            if wrong:
                if wrong != "member does not end":
                    pieces = [p for p in pieces if p.headers is None or p.headers.get("warc-block-digest", "").startswith("sha1:")]
                    for p in pieces:
                        p.reason = p.reason or wrong
                while pieces and pieces[-1].headers is None:  # what the error cut off is part of the member's gap
                    pieces.pop()
                if len(pieces) == 1 and pieces[0].inner_length == len(inner):
                    pieces = []
                if bad >= 0 and pieces:
                    yield Piece(bad, at - bad, reason)
                    bad = -1
                yield from pieces
                if pieces:
                    given, until = {_same(p) for p in pieces if p.headers}, end
            elif pieces and not any(p.headers for p in pieces):
                if bad < 0:
                    bad, reason = at, pieces[0].reason
                at = end
                continue
        else:
            try:
                piece, end = _parse(data, at)
                pieces = [] if at < until and _same(piece) in given else [piece]
            except ValueError as error:
                wrong = str(error)
        if wrong:
            if bad < 0:
                bad, reason = at, wrong
            member, version = data.find(_MEMBER, at + 1), _VERSION.search(data, at + 1)
            at = min(x for x in (member if member >= 0 else len(data), version.start() if version else len(data)))
            continue
        if bad >= 0 and (pieces or at >= until):
            yield Piece(bad, at - bad, reason)
            bad = -1
        yield from pieces
        at = end
    if bad >= 0:
        yield Piece(bad, len(data) - bad, reason)


def _same(piece: Piece) -> tuple:
    return tuple(piece.headers.items()), piece.block


_FOUND = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
                    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("inner_offset", pa.int64()),
                    ("inner_length", pa.int64())])


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{_PAGE}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _row(file: str, piece: Piece) -> dict:
    row = {"file": file, "offset": piece.offset, "length": piece.length, "reason": piece.reason or None,
           "inner_offset": piece.inner, "inner_length": piece.inner_length}
    if piece.headers is not None:
        head = piece.headers
        http, _, payload = piece.block.partition(b"\r\n\r\n")
        size = re.search(rb"(?im)^Content-Length: *(\d+)", http)
        kind = head["warc-type"]
        row |= {"page_id": _number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": kind,
                "payload_bytes": int(size[1]) if kind == "revisit" and size else len(payload),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or digest32(payload),
                "refers_to": _number(head.get("warc-refers-to"))}
    return row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path`` and every quarantined gap, as rows.

    Records have ``page_id, url, record_type, payload_bytes, payload_digest, refers_to``; gaps have a ``reason`` and nulls
    there; both have ``file, offset, length``, and those in a gzip member ``inner_offset, inner_length`` in its inflated
    bytes (see ``salvage``). All files are read, in folders below too, whatever their names, but for those that begin with
    ``_`` or ``.``, which Spark's readers pass over. A file is read by one task and has to fit its memory
    (``write_warc`` bounds its files). A folder without files gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for piece in salvage(content.as_py()):
                    rows.append(_row(file, piece))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(
        run, "file string, offset bigint, length bigint, reason string, page_id bigint, url string, record_type string, "
        "payload_bytes bigint, payload_digest string, refers_to bigint, inner_offset bigint, inner_length bigint")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back (see ``write_warc``, ``read_warc``)."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
