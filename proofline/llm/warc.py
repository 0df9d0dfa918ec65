"""WARC archives: a writer, and a reader that salvages damaged ones (operator 4).

*Writer.* Each record is a gzip member of its own. Of pages with equal payloads, the one with the
largest page_id is archived in full; the others become revisit records that refer to it. Files are
made by Spark's own text writer, so they go to any file system Spark knows and are committed by task:
a record's bytes are a row, and the row separator is the zero byte in which every member ends. (The
last byte of a member is the top byte of its length; a record of 16 MB or more gets an empty member
after it.) Only pages that a fixed-size filter suspects to be revisits are shuffled.

*Reader.* It walks a file from valid record to valid record. A record counts once its member's
checksum, its lengths and its digests agree. After a failed check it looks for the next gzip magic or
version line from which a record passes, logs the bytes between as quarantined, and goes on.

Results for odd input: null html is an empty payload; a null page_id never stands for others unless
all page_ids of its payload are null; repeated page_ids with the largest id of their payload are all
responses; a null url is left out; control characters in urls are percent-encoded; an empty table
gives an empty archive and no records; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILE_BYTES = 16 << 20
LEVEL = 4
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_EMPTY = zlib.compress(b"", LEVEL, 31)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """The bytes of an uncompressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    z = zlib.compress(data, LEVEL, 31)
    return z if z[-1] == 0 else z + _EMPTY


@dataclass
class Record:
    offset: int
    length: int
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    checked: bool = False


class Bad(Exception):
    """A check that failed."""


def _page_id(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at ``at`` of uncompressed bytes, and where it ends."""
    head_end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or head_end < 0:
        raise Bad("version line or header")
    fields: dict[str, str] = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header line")
        fields[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d+", fields.get("content-length", "")):
        raise Bad("content length")
    start = head_end + 4
    end = start + int(fields["content-length"])
    block = data[start:end]
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise Bad("record end")
    digest = fields.get("warc-block-digest", "")
    if digest and digest != f"sha1:{sha1_base32(block)}":
        raise Bad("block digest")
    kind = fields.get("warc-type", "")
    split = block.find(b"\r\n\r\n")
    payload: bytes | None = block[split + 4 :] if split >= 0 else block
    size = len(payload)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
        size, payload = int(m[1]) if m else 0, None
    elif stated and stated != sha1_base32(payload):
        raise Bad("payload digest")
    shown = stated or sha1_base32(payload or b"")
    return Record(at, end + 4 - at, kind, _page_id(fields.get("warc-record-id")), _page_id(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, shown, payload, bool(digest)), end + 4


def _gunzip(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` holds as far as it can be read, where it ends, and what is wrong with it
    (nothing: empty). Input is fed in pieces: what follows is never copied."""
    d, out, pos, step = zlib.decompressobj(31), [], at, 1 << 13
    while not d.eof:
        piece = data[pos : pos + step]
        if not piece:
            return b"".join(out), len(data), "cut short"
        before = d.copy()
        try:
            out.append(d.decompress(piece))
        except zlib.error as e:
            for i in range(len(piece)):  # what comes before the break, byte by byte
                try:
                    out.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), pos, f"member: {e}"
        pos += len(piece)
        step = min(1 << 16, 2 * step)
    return b"".join(out), pos - len(d.unused_data), ""


def _inside(inner: bytes, whole: bool) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """Valid records of a member, and gaps between them. Those of a member that failed its checksum
    must have a block digest of their own."""
    found: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    pos, bad = 0, None
    while pos < len(inner):
        try:
            r, end = _parse(inner, pos)
            if not whole and not r.checked:
                raise Bad("no digest in a damaged member")
        except Bad as e:
            bad = bad or (pos, str(e))
            pos = inner.find(VERSION, pos + 1)
            if pos < 0:
                break
            continue
        if bad:
            gaps.append((bad[0], pos, bad[1]))
            bad = None
        found.append(r)
        pos = end
    if bad:
        gaps.append((bad[0], len(inner), bad[1]))
    return found, gaps


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Valid records and quarantined gaps (start, end, reason), in the order of their bytes. Records
    of a member that is damaged elsewhere are kept; its range is logged as a gap all the same."""
    at, bad_from, reason = 0, None, ""
    while at < len(data):
        found: list[Record] = []
        inner_gaps: list[tuple[int, int, str]] = []
        why, end = "", at
        if data.startswith(MAGIC, at):
            inner, end, why = _gunzip(data, at)
            found, inner_gaps = _inside(inner, not why)
            for r in found:
                r.offset, r.length = at, end - at
            if not why and inner_gaps and not found:
                why = inner_gaps[0][2]
        elif data.startswith(VERSION, at):
            try:
                r, end = _parse(data, at)
                found.append(r)
            except Bad as e:
                why = str(e)
        elif data[at] in b"\0\r\n" and bad_from is None:
            at += 1
            continue
        else:
            why = "no record starts here"
        if why:
            yield from found
            if bad_from is None:
                bad_from, reason = at, why
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad_from is not None and (found or end == len(data)):
            yield bad_from, at, reason
            bad_from = None
        yield from found
        for a, z, what in inner_gaps:
            yield at, end, f"{what}, in bytes {a} to {z} of the member"
        at = end
    if bad_from is not None:
        yield bad_from, len(data), reason


RECORDS = "file string, offset bigint, length bigint, record_type string, page_id bigint, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary, reason string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            out.append(member(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["refers_to"], r["revisit"])))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def _salvaged(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows, held = b.column("path")[i].as_py(), [], 0
                for x in salvage(b.column("content")[i].as_buffer().to_pybytes()):
                    if isinstance(x, Record):
                        rows.append((file, x.offset, x.length, x.kind, x.page_id, x.refers_to, x.url, x.payload_bytes, x.payload_digest, x.payload if with_payload else None, None))
                        held += len(x.payload or b"") * with_payload
                    else:
                        rows.append((file, x[0], x[1] - x[0], "quarantined", None, None, None, None, None, None, x[2]))
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def write_archives(pages: DataFrame, path: str) -> None:
    """Archive ``pages`` (page_id, url, html) as files of gzip members under ``path``. The mean size
    of a payload reaches the driver; it bounds the records of a file."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha2(html, 256)).alias("payload"))
    thin = common.store(rows.select("page_id", "payload", F.octet_length(html).cast("long").alias("bytes")), "payloads")
    first = thin.groupBy("payload").agg(F.max("page_id").alias("refers_to"))
    back = common.store(thin.join(first, "payload").where("page_id < refers_to or (page_id is null and refers_to is not null)").select("page_id", "payload", "refers_to").distinct(), "revisits")
    mean = thin.agg(F.avg("bytes")).first()[0] or 0.0
    hit = common.slot_udf(spark, common.id_filter(back, "page_id", "payload"))
    marked = rows.withColumn("hit", hit(common.filter_slot("page_id", "payload")))
    whole = marked.where("not hit").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    r = back.select(F.col("page_id").alias("p"), F.col("payload").alias("q"), "refers_to")
    maybe = marked.where("hit").join(r, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload") == F.col("q")), "left")
    maybe = maybe.select("page_id", "url", "html", "refers_to", F.col("q").isNotNull().alias("revisit"))
    out = whole.unionByName(maybe).mapInArrow(_members, "member binary").select(F.col("member").substr(F.lit(1), F.octet_length("member") - 1).cast("string").alias("value"))
    with common.text_batches(spark):
        out.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1024)))).text(path)
    common.discard(thin, back)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``, and a row of record_type 'quarantined' (with file,
    offset, length and reason) for every gap. A file is read as one value, so its size bounds a
    task's memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged(with_payload), RECORDS)


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if a gap is found in archives that it has just written itself."""
    path = common.new_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    with common.text_batches(spark):
        records = common.store(read_archives(spark, path, with_payload=False).drop("payload"), "records")
    lost = records.where("record_type not in ('response', 'revisit')").select("file", "offset", "length", "reason").first()
    if lost is not None:
        raise RuntimeError(f"an archive came back damaged: {lost.asDict()}")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A digest's 40 hex digits are eight numbers of 20 bits, each four letters of base 32.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
r as (select page_id, t, max(page_id) over (partition by t) as last, sha1(t) as h from p)
select page_id, strlen(t) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_LETTERS}', cast((cast('0x' || substr(h, cast(i // 4 * 5 + 1 as integer), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as integer) + 1, 1)), '') as payload_digest,
  case when page_id < last then 'revisit' else 'response' end as record_type, case when page_id < last then last end as refers_to
from r
"""
