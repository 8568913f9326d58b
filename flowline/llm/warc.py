"""WARC archives as chunked record tables.

A payload is rows of (record, chunk number, bytes), at most CHUNK bytes each, on its way into an archive and out of it: neither
writing nor reading holds a record in one piece.  Digests are carried from chunk to chunk.  Tasks write
archives of their own into a shared folder and answer with the segments they wrote; only these answers, kept as a table, make an
archive part of the result, so files of failed attempts are never read.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise, shared_dir, small

#: Bytes of a chunk, compressed bytes from which a segment ends, bytes of payload that a batch of read chunks may hold.
CHUNK, SEGMENT, BATCH = 1 << 16, 16 << 20, 8 << 20
#: Longest header line that is read.
LINE = 1 << 16
#: Records with equal payloads from this many bytes on are written once.
LEAST = 0
#: Date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"

# The format's version, record types and profile of a revisit.
VERSION, RESPONSE, REVISIT = b"WARC/1.1", "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEGMENTS = "file string, start bigint, length bigint, records bigint"
CHUNKS = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, stated_bytes bigint, chunk_no bigint, chunk binary, n_bytes bigint, digest string, last boolean, whole boolean"


def chunked(records: DataFrame, payload: str, size: int = CHUNK) -> DataFrame:
    """``records`` with ``chunk_no`` and ``chunk`` instead of the binary column ``payload``: its pieces in order, an empty one if it has none."""
    last = F.floor((F.greatest(F.octet_length(payload), F.lit(1)) - 1) / size).cast("bigint")
    each = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    piece = F.when(F.octet_length(payload) <= size, F.col(payload)).otherwise(F.substring(F.col(payload), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)))
    return each.withColumn("chunk", piece).drop(payload)


def gathered(chunks: DataFrame, key: str = "record_id") -> DataFrame:
    """Chunk rows from any order: each record's in one partition, by number.  Tables made by :func:`chunked` needn't be."""
    return chunks.repartition(key).sortWithinPartitions(key, "chunk_no")


def identity(payload: Column) -> Column:
    """By which payloads are equal: their SHA-256."""
    return F.unhex(F.sha2(payload, 256))


def roles(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` (page, identity, n_bytes ...) with ``refers_to``: the largest page of an equal payload, for all but that page itself.

    Payloads under ``least`` bytes refer to none.  Only payloads that occur under several pages are looked up, by broadcast where their measured size allows.
    """
    narrow = records.where(F.col("n_bytes") >= least).select("identity", "page")
    held = narrow.groupBy("identity").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("identity", "first")
    found = records.join(small(materialise(held, "equal")), "identity", "left")
    other = F.col("first").isNotNull() & (F.col("n_bytes") >= least) & ~F.col("first").eqNullSafe(F.col("page"))
    return found.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def _clean(uri: str | None) -> str:
    """A header value without bytes that would end or split it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def _head(kind: str, record: str, uri: str | None, refers: str | None, digest: bytes, n: int, date: str) -> bytes:
    """Header of a record and, since its block is an HTTP message, the message's head, which states the payload's length for revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = len(http) + (n if kind == RESPONSE else 0)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + b32encode(digest).decode())]
    fields += [("WARC-Target-URI", _clean(uri))] if uri else []
    fields += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", PROFILE)] if kind == REVISIT else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(block))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def write(chunks: DataFrame, folder: str, date: str = DATE, level: int = 6) -> DataFrame:
    """Writes chunk rows to gzip archives in ``folder``, one member a record; returns the SEGMENTS written, a table that must be kept to be read.

    ``chunks`` has record_id, refers_to (a record id; null: a response), target_uri, n_bytes, sha1 (20 bytes), chunk_no, chunk, each record's rows in order in
    one partition, a revisit's being one of no bytes.  The folder is one that all executors reach, named by a URI.  A payload that doesn't have the stated length or digest fails its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        done: list[tuple] = []
        out, at, since, held, member, body, left, stated = None, 0, 0, 0, None, sha1(), 0, b""
        for b in batches:
            for record, refers, uri, n, digest, no, chunk in zip(*[b.column(k).to_pylist() for k in range(6)], b.column(6)):
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                if no == 0:
                    if member is not None:
                        raise ValueError("a record ended before its stated length")
                    kind = RESPONSE if refers is None else REVISIT
                    member, body, left, stated = zlib.compressobj(level, zlib.DEFLATED, 31), sha1(), n if refers is None else 0, digest
                    at += out.write(member.compress(_head(kind, record, uri, refers, digest, n, date)))
                if member is None:
                    raise ValueError("chunks of a record aren't in order")
                data = chunk.as_buffer()
                body.update(data)
                left -= data.size
                at += out.write(member.compress(data))
                if left <= 0:
                    if left < 0 or refers is None and body.digest() != stated:
                        raise ValueError("a payload differs from its stated length or digest")
                    at += out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, held = None, held + 1
                    if at - since >= SEGMENT:
                        done.append((name, since, at - since, held))
                        since, held = at, 0
        if member is not None:
            raise ValueError("a record ended before its stated length")
        if out is not None:
            out.close()
            if held:
                done.append((name, since, at - since, held))
        columns = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["file", "start", "length", "records"])

    return chunks.select("record_id", "refers_to", "target_uri", "n_bytes", "sha1", "chunk_no", "chunk").mapInArrow(run, SEGMENTS)


class _Part(io.RawIOBase):
    """A stretch of a file as a stream of its own; without a length it goes to the file's end."""

    def __init__(self, file: pa.NativeFile, start: int, length: int | None):
        file.seek(start)
        self.file, self.left = file, length

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read(len(into) if self.left is None else min(len(into), self.left))
        into[: len(data)] = data
        if self.left is not None:
            self.left -= len(data)
        return len(data)


def _fields(stream: io.BufferedReader) -> dict[str, str]:
    """Header lines up to an empty one, names in lower case; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = ""
    while (line := stream.readline(LINE)).strip():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def _id(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">") if value else None


def _records(stream: io.BufferedReader, size: int) -> Iterator[tuple]:
    """Chunk rows of every record of a stream, in the columns of CHUNKS."""
    while line := stream.readline(LINE):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = _fields(stream)
        kind, left = head.get("warc-type"), int(head["content-length"])
        length = None
        if head.get("content-type", "").startswith("application/http"):
            block = _Block(stream, left)
            http = io.BufferedReader(block, size)
            http.readline(LINE)
            length = _fields(http).get("content-length")
            body: io.BufferedReader | io.RawIOBase = http
        else:
            body = block = _Block(stream, left)
        digest = head.get("warc-payload-digest")
        stated = digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else None
        facts = (_id(head.get("warc-record-id")), kind, head.get("warc-target-uri"), _id(head.get("warc-refers-to")), stated, int(length) if length and length.isdigit() else None)
        running, n, no = sha1(), 0, 0
        chunk = _full(body, size)
        while True:
            after = _full(body, size) if len(chunk) == size else b""
            running.update(chunk)
            n += len(chunk)
            last = not after
            yield (*facts, no, chunk, n, b32encode(running.digest()).decode(), last, block.left == 0 if last else None)
            if last:
                break
            chunk, no = after, no + 1


class _Block(io.RawIOBase):
    """The block of the record at which a stream stands; ``left`` is what the stream didn't have."""

    def __init__(self, stream: io.BufferedReader, length: int):
        self.stream, self.left = stream, length

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(min(len(into), self.left))
        into[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _full(body, size: int) -> bytes:
    """The next ``size`` bytes, fewer only at the end."""
    parts, n = [], 0
    while n < size and (data := body.read(size - n)):
        parts.append(data)
        n += len(data)
    return b"".join(parts)


def read(segments: DataFrame, folder: str, size: int = CHUNK, payload: bool = True) -> DataFrame:
    """CHUNKS of all records in ``segments`` (file, start, length; a null length goes to the end of the file), archives being gzip or plain.

    ``n_bytes`` and ``digest`` (base32 SHA-1) are those of the payload up to and with the chunk, so the ``last`` one has the
    payload's; ``whole`` then says whether the archive had as many bytes as the record states.  The payload of an HTTP message is
    its body, and that of other records their block.  ``stated_bytes`` is the message's own length, which revisits have without a body.
    Without ``payload``, only the last chunk of each record is told, without its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        rows: list[tuple] = []
        weight = 0
        for b in batches:
            for name, start, length in zip(*[b.column(k).to_pylist() for k in range(3)]):
                with system.open_input_file(f"{base}/{name}") as file:
                    raw = io.BufferedReader(_Part(file, start or 0, length), 1 << 20)
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
                    for row in _records(stream, size):
                        if not payload:
                            if not row[10]:
                                continue
                            row = (*row[:7], None, *row[8:])
                        rows.append(row)
                        weight += 200 + len(row[7] or b"")
                        if weight >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return segments.select("file", "start", "length").mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> tuple[DataFrame, str]:
    """Writes a record for every row of ``pages``; returns the SEGMENTS, kept as a table, and their folder.

    The payload is the column's bytes (null: none).  Of equal payloads of ``least`` bytes or more, the largest id's record is a response and
    the others revisit it; rows that repeat that id are responses too, and a null id is never the largest beside others.  Without a url the
    record has no target.  An empty table gives no archives; other columns don't matter, whatever their names.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("target_uri"), data.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "identity": identity(F.col("payload")), "sha1": F.unhex(F.sha1("payload"))})
    named = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    told = roles(rows, least)
    told = told.select(named(F.col("page")).alias("record_id"), F.when(F.col("refers_to").isNotNull(), named(F.col("refers_to"))).alias("refers_to"), "target_uri", "n_bytes", "sha1", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    return materialise(write(chunked(told, "payload"), folder), "segments"), folder


def page_of(record: Column) -> Column:
    """The page that a record id of :func:`archive` names."""
    return F.regexp_extract(record, "^urn:x-page:(.*)$", 1).try_cast("bigint")


def told(segments: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of every record read back from :func:`archive`.

    A response's length and digest are those of the bytes read; a revisit has no body and tells those of the payload it stands for.
    ``intact`` says that the archive was whole and the bytes read have the digest stated.
    """
    spread = segments.repartition(max(1, segments.count()), "file", "start")
    last = read(spread, folder, payload=False).where("last")
    own = F.col("record_type") != REVISIT
    intact = F.col("whole") & (~own | F.coalesce(F.col("digest") == F.col("stated_digest"), F.lit(True)))
    return last.select(
        page_of(F.col("record_id")).alias("page_id"), F.when(own, F.col("n_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"), intact.alias("intact"),
    )
