"""WARC archives: a writer, and a splittable reader of archives in which each record is a gzip member.

The reader cuts the files into byte ranges. A task scans its range for gzip's magic number; a place counts as a
record's start only if a member decodes from there and begins with a WARC header, so magic numbers inside of
compressed data are passed over, and only if the members that follow it lead on from one to the next to the end of the range, so that archives
inside of a record's data are passed over too (but for one that is stored uncompressed, in a record that goes on beyond the range it starts in, to
that range's end). A record belongs to the range its first byte is in, and is read to its end beyond the range; the reader then makes sure that another starts there.

The folder must be one that pyarrow can open on the executors (a shared mount, hdfs, s3 or gs).
Each writing task names its files anew, and only those in the list that it returns count, so retries and
lost executors leave no record twice; what a failed attempt leaves behind isn't listed.

A record that can't be unpacked, or whose payload hasn't its digest, is an error, never left out; op4 holds the records read against those written besides.

Defined results: a null payload is an empty one; a null id or address leaves its header out; payloads of any size are kept
whole; repeated rows are repeated records; an empty table gives no files and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
#: Distinct repeated payloads up to which their table is broadcast, at under 100 bytes each; beyond it, it is joined by a shuffle.
BROADCAST_ROWS = 100_000
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with one response record, or a revisit record without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else []
    lines += [f"WARC-Target-URI: {clean(url)}"] if url is not None else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_warc(pages: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes (page_id, url, html, refers_to) to archives; returns the list (path, length, records), already made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_fs(folder)
        store.create_dir(at, recursive=True)
        out, path, size, n = None, "", 0, 0
        made = []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, size, n = f"{at}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                out.write(x := record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                size, n = size + len(x), n + 1
                if size >= file_bytes:
                    out.close()
                    made.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, n))
        prefix = folder[: folder.index("://") + 3] + (folder.split("://")[1].split("/")[0] if not folder.startswith("file") else "") if "://" in folder else ""
        rows = [(prefix + p if not p.startswith(prefix) or not prefix else p, s, k) for p, s, k in made]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "length", "records"])

    return cut(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, length long, records long"))


class Range:
    """Bytes of a file from `start` on, read when asked for."""

    def __init__(self, source, start: int):
        self.source, self.base, self.pos, self.data = source, start, 0, b""

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        if self.pos >= CHUNK:
            self.data, self.base, self.pos = self.data[self.pos :], self.at, 0
        self.source.seek(self.base + len(self.data))
        got = self.source.read(CHUNK)
        self.data += got
        return bool(got)

    def ended(self) -> bool:
        return self.pos >= len(self.data) and not self.more()


def member(r: Range) -> tuple[bytes, int] | None:
    """What the gzip member at the range's place holds, and its length; None if no whole WARC record starts there."""
    unpack, parts, used, head = zlib.decompressobj(31), [], 0, b""
    while not unpack.eof:
        if unpack.unconsumed_tail:
            piece = unpack.unconsumed_tail
        else:
            if r.pos + used >= len(r.data) and not r.more():
                return None
            piece = r.data[r.pos + used : r.pos + used + CHUNK]
            used += len(piece)
        try:
            parts.append(unpack.decompress(piece, CHUNK))
        except zlib.error:
            return None
        if len(head) < 7:
            head += parts[-1][: 7 - len(head)]
            if not b"WARC/1.".startswith(head):
                return None  # before the rest is unpacked
    return (b"".join(parts), used - len(unpack.unused_data)) if head == b"WARC/1." else None


def leads_on(source, start: int, end: int) -> bool:
    """Whether members follow each other from start to one at `end` or beyond, or to the file's end; ValueError if a member is damaged."""
    r = Range(source, start)
    first = True
    while got := member(r):
        r.pos += got[1]
        if r.ended():
            return True
        while len(r.data) - r.pos < len(MAGIC) and r.more():
            pass
        if not r.data.startswith(MAGIC, r.pos):
            return False
        if r.at >= end:
            return True
        first = False
    if not first:
        raise ValueError(f"damaged record at byte {r.at}")
    return False


def records_from(source, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    r = Range(source, start)
    sure = start == 0  # that a record starts here
    while r.at < end:
        if not sure:
            found = r.data.find(MAGIC, r.pos)
            if found < 0:
                r.pos = max(r.pos, len(r.data) - len(MAGIC) + 1)
                if not r.more():
                    return
                continue
            r.pos = found
            if r.at >= end:
                return
            if not leads_on(source, r.at, end):
                r.pos += 1
                continue
            sure = True
        if r.ended():
            return
        got = member(r)
        if not got:
            raise ValueError(f"damaged record at byte {r.at}")
        yield got[0]
        r.pos += got[1]
    if sure and not r.ended() and not member(r):  # the next range would take it for a false magic number
        raise ValueError(f"damaged record at byte {r.at}")


def parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if fields.get("warc-type") == "revisit":  # the length of what isn't repeated here
            size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    digest = fields.get("warc-payload-digest", "")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") and len(digest) == 37 else digest or None
    if fields.get("warc-type") == "response" and digest and len(digest) == 40 and digest != hashlib.sha1(payload).hexdigest():
        raise ValueError(f"the payload of {fields.get('warc-record-id')} hasn't its digest")
    return fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, payload


def read_warc(files: DataFrame, split_bytes: int = 32 << 20, payload: bool = True) -> DataFrame:
    """Records of the archives (path, length), as RECORD; without `payload`, that column is null."""
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.repartition("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, at = open_fs(path)
                rows, held = [], 0
                with store.open_input_file(at) as source:
                    for raw in records_from(source, start, start + split_bytes):
                        x = parse(raw)
                        rows.append(x if payload else (*x[:6], None))
                        held += len(x[6])
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    return ranges.mapInArrow(run, RECORD)


def with_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages and refers_to: for a page whose payload, of `least` bytes or more, a page of larger id has too, the largest such id.

    The pages' texts aren't shuffled unless there are more than BROADCAST_ROWS distinct repeated payloads.
    """
    whole = pages.select(F.struct(*(c for c in pages.columns if c != "refers_to")).alias("_page"))  # so no column's name can clash
    html = F.encode(F.coalesce("_page.html", F.lit("")), "utf-8")
    keyed = whole.withColumn("_key", F.when(F.octet_length(html) >= least, F.sha2(html, 256)))
    repeated = cut(keyed.where("_key is not null").groupBy("_key").agg(F.max("_page.page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_last"))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = keyed.join(repeated, "_key", "left")
    return joined.select("_page.*", F.when(~F.col("_page.page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write_warc(with_originals(pages), folder)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    found = cut(read_warc(files, payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
    written, read = files.agg(F.sum("records")).first()[0] or 0, found.count()
    if written != read:
        raise ValueError(f"{written} records were written and {read} read")
    if written:
        store, at = open_fs(folder)
        store.delete_dir(at)  # the archives have been read
    return found


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
