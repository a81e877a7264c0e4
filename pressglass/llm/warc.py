"""WARC archives with a two-level capture index.

Records are gzip members of their own, so a range read gets one.  The index has two levels: lines `key page offset
length file`, sorted by reversed-host URL key and page, in gzip blocks of BLOCK_LINES lines; and a sparse directory, one line
for each block with its first key and its place.  A lookup is a binary search in the directory, one block, one range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, bounded_batches, numbered, shared_folder, stored

BLOCK_LINES = 300
#: Bytes of a WARC file before the next one begins.
FILE_BYTES = 1 << 28


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query: http://www.a.org/x?y -> org,a,www)/x?y. Anything without a host: the text itself."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "".join(url.split()).lower()
    if not host:
        return "".join(url.split())
    key = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(key.split())


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 response or revisit record; a revisit has the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields: headers in lower case, http_length, payload (of a response)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return headers | {"http_length": length, "payload": payload}


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "None") else None


def digest_of(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row; returns the capture lines (key, page_id, file, offset, length), stored.

    pages: page_id, url, html (null: empty).  Of equal payloads of at least `least` bytes the one with the largest
    page_id (of repeated rows, any one) is the response, others revisit it; smaller ones are all responses.  Files of lost task
    attempts are in no line.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    read = numbered(pages, "_rid").select(F.col("_rid").alias("rid"), "page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), digest_of(html).alias("digest"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("same"), F.octet_length(html).alias("size"))
    # No payload travels: SHA-256 tells equal ones, and what became of each row is joined to the rows by its number.
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "rid")).alias("best")
    firsts = read.where(F.col("size") >= least).groupBy("same", "size").agg(best, F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("g_same"), F.col("size").alias("g_size"), F.col("best.page_id").alias("refers_to"), F.col("best.rid").alias("g_rid"))
    slim = read.select("rid", "same", "size").withColumn("hash", F.xxhash64("same"))
    firsts = firsts.withColumn("g_hash", F.xxhash64("g_same"))
    links = slim.join(firsts, (F.col("hash") == F.col("g_hash")) & (F.col("same") == F.col("g_same")) & (F.col("size") == F.col("g_size"))).where("rid != g_rid").select("rid", "refers_to", F.lit(True).alias("again"))
    ready = read.drop("size", "same").join(stored(links, "revisits"), "rid", "left").select("page_id", "url", "html", "digest", "refers_to", F.coalesce("again", F.lit(False)).alias("again"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, html, digest, refers_to, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    where.create_dir(base, recursive=True)
                    path, at = f"{base}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(path, compression=None)
                sha = base64.b32encode(bytes.fromhex(digest)).decode()
                data = gzip.compress(record("revisit" if again else "response", " ".join(url.split()), page_id, html.encode(), sha, refers_to), 6, mtime=0)
                out.write(data)
                lines.append((url_key(url), page_id, path, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines, strict=True), [pa.string(), batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64()], strict=True)], names=["key", "page_id", "file", "at", "length"])
        if out:
            out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return stored(ready.mapInArrow(each, f"key string, page_id {kind}, file string, at long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """The index's blocks, one file for each range of keys; returns the directory, stored: first_key, first_page, file, at, length."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, path, at, lines, found = None, "", 0, [], []

        def put():
            nonlocal at
            data = gzip.compress("".join(f"{k} {p} {f} {a} {n}\n" for k, p, f, a, n in lines).encode(), 6, mtime=0)
            out.write(data)
            found.append((lines[0][0], lines[0][1], path, at, len(data)))
            at += len(data)

        for batch in batches:
            if out is None:
                where.create_dir(base, recursive=True)
                path = f"{base}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
                out = where.open_output_stream(path, compression=None)
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    put()
                    lines = []
        if lines:
            put()
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=["first_key", "first_page", "file", "at", "length"])

    kind = "first_key string, first_page long, file string, at long, length long"
    return stored(ordered.select("key", "page_id", "file", "at", "length").mapInArrow(each, kind), "directory")


def _lines(data: bytes) -> list[tuple[str, int | None, str, int, int]]:
    out = []
    for line in gzip.decompress(data).decode().splitlines():
        key, page, file, at, length = line.rsplit(" ", 4)
        out.append((key, None if page == "None" else int(page), file, int(at), int(length)))
    return out


class Index:
    """A lookup: directory rows sorted by key (they are sparse: one for BLOCK_LINES captures)."""

    def __init__(self, directory: list[tuple[str, int | None, str, int, int]], folder: str):
        self.rows = sorted(directory, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        self.firsts = [r[0] for r in self.rows]
        self.where, _ = pyarrow.fs.FileSystem.from_uri(folder)

    def captures(self, url: str) -> list[tuple[str, int | None, str, int, int]]:
        """All captures of a URL: the block before the first one that begins with a larger key, and equal-keyed ones before it."""
        key, found = url_key(url), []
        i = bisect_right(self.firsts, key) - 1
        while i >= 0:
            _, _, path, at, length = self.rows[i]
            with self.where.open_input_file(path) as f:
                f.seek(at)
                found = [x for x in _lines(f.read(length)) if x[0] == key] + found
            if self.firsts[i] < key:
                break
            i -= 1
        return found

    def records(self, url: str) -> list[dict]:
        out = []
        for _, _, path, at, length in self.captures(url):
            with self.where.open_input_file(path) as f:
                f.seek(at)
                out.append(parse(gzip.decompress(f.read(length))))
        return out


def url_keys(pages: DataFrame) -> DataFrame:
    """key: the distinct keys of pages' URLs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.coalesce("url", F.lit("")).alias("url")).mapInArrow(each, "key string").distinct()


def look_up(keys: DataFrame, directory: DataFrame, folder: str, tables: Scratch) -> DataFrame:
    """file, at, length of every capture of the keys, by the index.

    Keys and the directory's rows are sorted by range together, and each range hears of the last directory row before it.  So a
    task has the rows of its own range of keys: it finds a key's blocks by binary search among them and reads these only.
    """
    asked = keys.select("key", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length"))
    both = asked.unionByName(directory.select(F.col("first_key").alias("key"), "file", "at", "length"))
    both = tables.stored(both.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    row = F.struct("key", "file", "at", "length")
    last = both.groupBy("range").agg(F.max(F.when(F.col("file").isNotNull(), row)).alias("last"))
    order = Window.orderBy("range")  # a row for each range
    ahead = last.select("range", F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last")).where("last is not null")
    rows = both.select("range", "key", "file", "at", "length").unionByName(ahead.select("range", "last.*"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pyarrow.fs.FileSystem.from_uri(folder)
        now, firsts, blocks, known, lines = None, [], [], None, []
        for batch in batches:
            out = []
            for part, key, path, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, firsts, blocks = part, [], []
                if path is not None:
                    firsts.append(key)
                    blocks.append((path, at, length))
                    continue
                # Blocks that begin with the key itself, and the one before them.
                for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                    if blocks[i] != known:
                        known = blocks[i]
                        with where.open_input_file(known[0]) as f:
                            f.seek(known[1])
                            lines = _lines(f.read(known[2]))
                    first = bisect_left(lines, key, key=lambda x: x[0])
                    out += [x[2:] for x in lines[first : bisect_right(lines, key, key=lambda x: x[0])]]
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], names=["file", "at", "length"])

    # A range's directory rows come before its keys, so that a key's own blocks are known when it is looked up.
    dealt = rows.repartition("range").sortWithinPartitions("range", F.col("file").isNull(), "key", "file", "at")
    return dealt.mapInArrow(each, "file string, at long, length long")


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """captures: file, at, length -> page_id, payload_bytes, payload_digest, record_type, refers_to, read in ascending ranges.

    A response's length and digest come from its payload.  A revisit's are those of the response that it refers to (null
    if there is none whose payload has the digest that the revisit names).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pyarrow.fs.FileSystem.from_uri(folder)
        file, name = None, None
        for batch in batches:
            rows = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    file, name = where.open_input_file(path), path
                file.seek(at)
                r = parse(gzip.decompress(file.read(length)))
                own = (_page(r["warc-record-id"]), r["warc-type"])
                if own[1] == "response":
                    rows.append((*own, len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode(), None))
                else:
                    rows.append((*own, None, r["warc-payload-digest"].removeprefix("sha1:"), _page(r["warc-refers-to"])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    ordered = captures.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(each, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def read_archives(pages: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Every capture of the pages' URLs, looked up in the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    with Scratch(pages.sparkSession, "lookups") as tables:
        captures = tables.stored(look_up(url_keys(pages), directory, folder, tables), "captures")
        records = tables.stored(read_captures(captures, folder), "records")
        first = records.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("bytes"))
        first = first.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), F.col("payload_digest").alias("seen"), "bytes")
        again = records.where("record_type = 'revisit'").join(first, F.col("refers_to").eqNullSafe(F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest")), "left")
        again = again.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("seen").alias("payload_digest"), "record_type", "refers_to")
        return stored(records.where("record_type = 'response'").select(*again.columns).unionByName(again), "pages")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per row of pages (page_id, url, html), from archives and an index of them that are written first: see read_archives().

    Null html counts as empty, null URLs share the key of an empty one, page_ids may be null or repeated, each row is a capture, other
    columns aren't read, and an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder, index = shared_folder(spark, "warc"), shared_folder(spark, "warc-index")
    return read_archives(pages, write_index(write_archives(pages, folder, least), index), index)
