"""Operator 4: WARC writing and a salvage reader.

Writing: every page becomes one gzip member holding one WARC/1.0 record.  Of
pages with equal payloads of at least ``min_dedup`` bytes, the one with the
largest id is stored (``response``); the others become ``revisit`` records that
refer to it.  Archives are written by Spark's own writer (task commit, any file
system), one file per row of about ``file_bytes`` bytes.

Reading: a file is one ``binaryFile`` row (so an archive must fit one task: keep
files below about 256 MB).  Members and plain records are checked (gzip CRC,
header syntax, Content-Length, record trailer, payload digest).  After a failed
check the reader searches for the next gzip magic or ``WARC/1.`` line that
again gives a valid record, goes on from there, and logs the skipped bytes as a
gap row (file, offset, length, reason).  The search also goes on inside a member: an intact member
with a bad record gives its other records and a gap row (the member's place; the reason names the bytes
of the inflated data), and a damaged or cut member gives the records before the damage, with its place
and length 0, as the member's bytes are a gap.  More than ``PADDING`` zero bytes in a row between
records are a gap too.

Edge cases: a null payload is empty; a null or odd URL is percent-escaped or left out;
pages that tie on the largest id are all responses; a null id is written as
``null`` and read back as null, and never stores for others; an empty table
writes no archive and reads back no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch
from foldwise.operators.joins import join_stats

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:page:"
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PADDING = 4                          # zero bytes between records that are not worth a gap row
STAMP = "1970-01-01T00:00:00Z"       # archives of the same pages are equal byte for byte
READ_SCHEMA = ("file string, offset long, length long, reason string, record_type string, page_id long, "
               "refers_to long, url string, payload_bytes long, payload_digest string, payload binary")


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                 min_dedup: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, keeper): ``keeper`` is the id that stores
    this payload, null for a page that stores its own."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        body.cast("binary").alias("payload"), F.sha1(body.cast("binary")).alias("digest"))
    shared = (rows.filter(F.octet_length("payload") >= min_dedup).groupBy("digest")
              .agg(F.max("page_id").alias("store"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1 and store is not null").select("digest", "store"))
    shared = Scratch(spark, "warc").put(shared, "shared")
    joined = join_stats(rows, shared, "digest", "left", shared.count())
    keeper = F.when(F.col("page_id").eqNullSafe(F.col("store")), F.lit(None)).otherwise(F.col("store"))
    return joined.select("page_id", "url", "payload", "digest", keeper.alias("keeper"))


def encode_record(page_id, url, payload: bytes, digest: str, keeper) -> bytes:
    """One WARC record with its trailer."""
    revisit = keeper is not None
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {STAMP}"]
    if url is not None:
        safe = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{keeper}>", f"WARC-Profile: {PROFILE}",
                 f"WARC-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(records: DataFrame, path: str, file_bytes: int = 8 << 20, level: int = 4,
               compress: bool = True) -> None:
    """Write planned records (``plan_records``) as archives below ``path``."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "keeper")]
            for i in range(batch.num_rows):
                record = encode_record(*(c[i].as_py() for c in cols))
                parts.append(gzip_member(record, level) if compress else record)
                held += len(parts[-1])
                if held >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    (records.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string"))
     .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


class BadRecord(ValueError):
    pass


def inflate(buf: bytes, pos: int, step: int = 65536) -> tuple[bytes, int, str | None]:
    """The gzip member at ``pos``, the position after it, and what is wrong with it (its CRC is checked).

    Of a damaged member the data before the damage come back: it is read again in small steps."""
    d = zlib.decompressobj(31)
    out, at = [], pos
    try:
        while not d.eof:
            piece = buf[at:at + step]
            if not piece:
                return b"".join(out), at, "truncated member"
            out.append(d.decompress(piece))
            at += len(piece)
    except zlib.error:
        return inflate(buf, pos, 64) if step > 64 else (b"".join(out), at, "bad member")
    return b"".join(out), at - len(d.unused_data), None


def _page(value: str | None):
    v = (value or "").strip("<> ")
    return int(v[len(URN):]) if v.startswith(URN) and v[len(URN):].lstrip("-").isdigit() else None


def parse_record(buf: bytes, pos: int) -> tuple[dict, int]:
    """The plain WARC record at ``pos`` and the position after its trailer."""
    end = buf.find(b"\r\n\r\n", pos)
    if not buf.startswith(VERSION, pos) or end < 0:
        raise BadRecord("no record header")
    fields = {}
    for line in buf[pos:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord("bad header line")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise BadRecord("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if buf[stop:stop + 4] != b"\r\n\r\n":
        raise BadRecord("no record trailer")
    block = buf[start:stop]
    if fields.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        block = block[cut + 4:] if cut >= 0 else block
    kind = fields.get("warc-type", "")
    label, _, said = fields.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        n = fields.get("warc-payload-length", "")
        got, length = said, int(n) if n.isdigit() else None
    else:
        got, length = hashlib.sha1(block).hexdigest(), len(block)
        if label == "sha1" and len(said) == 40 and said.lower() != got:
            raise BadRecord("payload digest")
    return {"record_type": kind, "page_id": _page(fields.get("warc-record-id")),
            "refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": got.lower() or None, "payload": block}, stop + 4


class Marks:
    """Places where a record or member may begin; what was found is kept, so a file is searched once."""

    def __init__(self, buf: bytes, members: bool):
        self.buf = buf
        self.at = {mark: -1 for mark in ((MEMBER, VERSION) if members else (VERSION,))}

    def after(self, pos: int) -> int:
        for mark, at in self.at.items():
            if at <= pos:
                found = self.buf.find(mark, pos + 1)
                self.at[mark] = found if found >= 0 else len(self.buf)
        return min(self.at.values())


def _lost(skipped: bytes) -> bool:
    """Whether skipped bytes are more than line ends and a little padding."""
    return bool(skipped.strip(b"\r\n\x00")) or skipped.count(0) > PADDING


def salvage(buf: bytes, members: bool = True) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(offset, length, reason, record): records in file order; gaps have a reason.

    Without ``members`` only plain records are read (the inflated data of a member)."""
    marks = Marks(buf, members)
    pos, gap, reason = 0, None, None
    while pos < len(buf):
        found, wrong = [], None
        if members and buf.startswith(MEMBER[:2], pos):
            data, after, wrong = inflate(buf, pos)
            for at, n, why, record in salvage(data, members=False):
                if wrong is None:
                    found.append((pos, after - pos, why and f"{why}, bytes {at} to {at + n} of the member", record))
                elif record:
                    found.append((pos, 0, None, record))
        else:
            try:
                record, after = parse_record(buf, pos)
                found.append((pos, after - pos, None, record))
            except BadRecord as e:
                wrong = str(e)
        if wrong is None and gap is not None:
            if _lost(buf[gap:pos]):
                yield gap, pos - gap, reason, None
            gap = None
        yield from found
        if wrong is None:
            pos = after
        else:
            if gap is None:
                gap, reason = pos, wrong
            pos = marks.after(pos)
    if gap is not None and _lost(buf[gap:]):
        yield gap, len(buf) - gap, reason, None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``; gap rows have ``reason`` set.

    Each record has its file, offset, type, ids, URL, payload size, payload digest
    and (unless switched off) the payload bytes; a revisit's payload is empty."""
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]])
                        for n, f in zip(names, READ_SCHEMA.split(", "), strict=True)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, buf = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, held = [], 0
                for offset, length, reason, record in salvage(buf):
                    row = {"file": file, "offset": offset, "length": length, "reason": reason} | (record or {})
                    if not with_payload:
                        row["payload"] = None
                    held += len(row.get("payload") or b"")
                    rows.append(row)
                    if len(rows) >= 5000 or held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, READ_SCHEMA)


def archive_pages(pages: DataFrame, **names) -> DataFrame:
    """Write the pages as archives below the checkpoint folder and read them back."""
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'warc-files').base}/archives"
    write_warc(plan_records(pages, **names), path)
    return read_warc(spark, path, with_payload=False)
