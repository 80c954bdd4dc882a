"""WARC archives: gzip members written by Spark tasks, and a splittable reader.

Writer: a record a page. Of records with equal payloads of `least` bytes or more, the
one with the smallest page_id is a response and the others revisit it (repeated
page_ids are all responses, null ids revisit, and a group of null ids only is all
responses). Only duplicates are joined with the page they refer to; payloads that
stand in very many pages are joined by broadcast of at most 500 rows.

Reader: a task gets a byte range of a file. It looks for the gzip magic from its first
byte on, takes a place as a member's start if what follows decodes to a WARC header,
then reads member after member. It owns the records that start inside its range and
reads past its end to finish the last. Damaged members are skipped up to the next
valid start. Files are cut into ranges of SPLIT bytes whatever their members.

Null html is an empty payload; null urls have no target header. An empty table makes
no file, and reading none gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import join_by_share, new_path, saved, table

SPLIT, STEP = 4 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
ID = "urn:tagquarry:page:"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A gzip member with a response, or with a revisit of another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html); the manifest: a row a file (file, size)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.when(F.octet_length("html") >= least, F.sha1("html")))
    first = pages.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 and sha1 is not null")
    first = saved(first, "payloads")
    total = pages.count()
    joined = join_by_share(pages, first, "sha1", "rows", total, F.coalesce("page_id", F.hash("url")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, size = None, 0
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"  # another try of this task writes another file
        try:
            for b in batches:
                for page, url, html, other in zip(*(b.column(i) for i in range(4))):
                    stream = stream or files.create(name)
                    member = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), other.as_py())
                    stream.write(member)
                    size += len(member)
        finally:
            if stream:
                stream.close()
        if stream:
            yield pa.RecordBatch.from_pydict({"file": [name], "size": pa.array([size], pa.int64())})

    return saved(joined.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(run, "file string, size long"), "warc-manifest")


class Window:
    """Bytes of a file from a moving place on."""

    def __init__(self, stream: Any, size: int, at: int):
        self.stream, self.size, self.at, self.data = stream, size, at, b""

    def more(self) -> bool:
        want = min(STEP, self.size - self.at - len(self.data))
        if want <= 0:
            return False
        self.stream.seek(self.at + len(self.data))
        self.data += self.stream.read(want)
        return True

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: Window) -> tuple[bytes, int] | None:
    """The member at the window's start and its length, or None if it isn't a whole WARC record."""
    try:
        if len(window.data) < 512:
            window.more()
        begin = zlib.decompressobj(31).decompress(window.data[:512], 5)
        if begin != b"WARC/":
            return None
        inflate, used, out = zlib.decompressobj(31), 0, []
        while not inflate.eof:
            if used == len(window.data) and not window.more():
                return None
            part = window.data[used : used + STEP]
            out.append(inflate.decompress(part))
            used += len(part)
        return b"".join(out), used - len(inflate.unused_data)
    except zlib.error:
        return None


def members(stream: Any, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end)."""
    window = Window(stream, size, start)
    while window.at < end:
        found = window.data.find(MAGIC)
        while found < 0:
            keep = len(MAGIC) - 1
            if window.at + len(window.data) - keep >= end or not window.more():
                return
            if len(window.data) > STEP + keep:
                window.skip(len(window.data) - STEP - keep)
            found = window.data.find(MAGIC)
        window.skip(found)
        if window.at >= end:
            return
        if got := _member(window):
            yield window.at, got[0]
            window.skip(got[1])
        else:
            window.skip(1)


def parsed(content: bytes) -> dict[str, Any]:
    """Type, ids, payload's length and digest, and the payload of a response."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields.get("WARC-Type") == "revisit":
        m = re.search(rb"(?im)^Content-Length: *([0-9]+)", http)
        n, sha, payload = int(m[1]) if m else 0, fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"), None
    else:
        n, sha = len(payload), digest(payload)

    def page(name: str) -> int | None:
        value = fields.get(name, "").strip("<>").removeprefix(ID)
        return int(value) if re.fullmatch("-?[0-9]+", value) else None

    return {"page_id": page("WARC-Record-ID"), "payload_bytes": n, "payload_digest": sha, "record_type": fields.get("WARC-Type"), "refers_to": page("WARC-Refers-To"), "url": fields.get("WARC-Target-URI"), "payload": payload}


def read(manifest: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """A row a record of the files in manifest (file, size)."""
    cuts = F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split}L)"))
    ranges = manifest.where("size > 0").select("file", "size", cuts.alias("start"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows: list[dict] = []
                with files.reader(name) as stream:
                    for _, content in members(stream, size, start, min(size, start + split)):
                        rows.append(parsed(content))
                        if len(rows) >= 64:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    tasks = max(1, ranges.count())
    return ranges.repartition(min(tasks, 100_000)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


_FIVE = "(('0x' || substr(sha, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31"
SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, strlen(html) as payload_bytes, sha1(html) as sha, min(page_id) over (partition by html) as first from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ({_FIVE}), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from s
"""
