"""WARC archives with a two-level capture index.

Archives are files of one gzip member per record, so a record can be read by its range. The index sorts captures by
URL with the host reversed; runs of captures are compressed blocks, and a sparse directory keeps each block's first
key, file, offset and length. A lookup binary-searches the directory, reads one block's range, then the record's range."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, bucketed, fresh_path, materialize, open_fs, shuffle_partitions

#: Payloads below so many bytes are stored each time.
LEAST = 100
ARCHIVE = 64 << 20
DATE = "2024-01-01T00:00:00Z"
#: Captures in a block, and the most blocks: with more captures than their product, blocks grow instead.
BLOCK, MOST_BLOCKS = 2_000, 50_000
ENTRY = "key string, page_id long, file string, offset long, length long"


def reversed_host(url: str) -> str:
    """com,example,www)/path?query: captures of a domain and its hosts stand together. An unreadable URL is kept as it is."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/:?#[]@!$&'()*+,;=%~")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    text = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail
    return quote(text, safe="/:?#[]@!$&'()*+,;=%~").lower()


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{reversed_host(url or '')} {'' if page_id is None else page_id}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A WARC record, uncompressed. A revisit carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload behind the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def gz(data: bytes, level: int = 4) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (binary), digest, size and refers_to: the smallest page_id of equal payloads, for the others."""
    own = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.coalesce(F.col("`html`").cast("binary"), F.lit(b"")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.length("html").cast("long"))
    seen = materialize(own.filter(F.col("size") >= least).select("digest", "page_id"), "warc-digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only ids move here; html moves once, to its archive
    refers = seen.join(first, "digest").filter("page_id <> first").select("page_id", F.col("first").alias("refers_to")).distinct()
    return own.join(refers, "page_id", "left").withColumn("refers_to", F.when(F.col("size") >= least, F.col("refers_to")))


def write_archives(planned: DataFrame, folder: str, most: int = ARCHIVE) -> DataFrame:
    """Write archives under folder; the captures (key, page_id, file, offset, length), stored in the shared folder.

    File names are new for each attempt and reach the result only with the task that ended, so a lost or repeated
    attempt leaves a file that nothing refers to."""

    def run(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        sink, name, at, rows = None, "", 0, []
        for b in batches:
            for r in batch_rows([b]):
                if sink is None:
                    name, at = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(name, compression=None)
                data = gz(record(r["page_id"], r["url"], r["html"], r["digest"], r["size"], r["refers_to"]))
                sink.write(data)
                rows.append((capture_key(r["url"], r["page_id"]), r["page_id"], name.rsplit("/", 1)[1], at, len(data)))
                at += len(data)
                if at >= most:
                    sink.close()
                    sink = None
            if rows:
                yield entries(rows)
                rows = []
        if sink is not None:
            sink.close()

    return materialize(planned.mapInArrow(run, ENTRY), "warc-captures")


def entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "page_id", "file", "offset", "length"])


class CaptureIndex:
    """The directory (bounded: MOST_BLOCKS rows, of about 200 bytes) of an index whose blocks lie beside the archives."""

    def __init__(self, folder: str, directory: list[tuple]):
        self.folder, self.directory = folder, sorted(directory)
        self.firsts = [d[0] for d in self.directory]

    @staticmethod
    def build(captures: DataFrame, folder: str, block: int = BLOCK) -> CaptureIndex:
        spark = captures.sparkSession
        total = captures.count()
        size = max(block, -(-total // MOST_BLOCKS))
        parts = min(shuffle_partitions(spark), -(-total // size) or 1)

        def run(batches):
            held = []

            def blocks():
                for b in batches:
                    for r in batch_rows([b]):
                        held.append(r)
                        if len(held) == size:
                            yield list(held)
                            held.clear()
                if held:
                    yield list(held)

            fs, base = open_fs(folder)
            fs.create_dir(base, recursive=True)
            sink, name, at = None, f"cdx-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz", 0
            for rows in blocks():
                sink = sink or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gz("\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]]) for r in rows).encode(), 6)
                sink.write(data)
                yield pa.RecordBatch.from_pylist([{"first": rows[0]["key"], "file": name, "offset": at, "length": len(data)}])
                at += len(data)
            if sink is not None:
                sink.close()

        ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
        made = materialize(ordered.mapInArrow(run, "first string, file string, offset long, length long"), "warc-directory")
        return CaptureIndex(folder, [tuple(r) for r in made.collect()])

    def blocks_of(self, key: str) -> list[int]:
        """Blocks that can hold the key: the last that begins before it, and any further ones that begin with it."""
        hi = bisect_right(self.firsts, key)
        lo = hi - 1
        while lo > 0 and self.firsts[lo] == key:
            lo -= 1
        return list(range(max(lo, 0), hi)) if hi else []

    def read_block(self, number: int) -> list[list]:
        _, file, offset, length = self.directory[number]
        fs, base = open_fs(self.folder)
        with fs.open_input_file(f"{base}/{file}") as f:
            return [json.loads(x) for x in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")]

    def lookup(self, url: str, page_id: int | None) -> list[tuple[dict[str, str], bytes]]:
        """The records of one capture."""
        key, fs_base = capture_key(url, page_id), open_fs(self.folder)
        found = [e for n in self.blocks_of(key) for e in self.read_block(n) if e[0] == key]
        out = []
        for _, _, file, offset, length in found:
            with fs_base[0].open_input_file(f"{fs_base[1]}/{file}") as f:
                out.append(parse_record(zlib.decompress(f.read_at(length, offset), 31)))
        return out

    def read(self, requests: DataFrame) -> DataFrame:
        """The records of all requested captures (page_id, url): each request finds its block by binary search, each
        block is read once, and the ranges in an archive are read in order by one task.

        page_id, record_type, payload_digest and payload_bytes as the record's headers tell them, refers_to, and
        payload, which is null for a revisit. Fails if a payload is not what its header says."""
        me = self

        def find(batches):
            for b in batches:
                rows = [(n, capture_key(r["url"], r["page_id"])) for r in batch_rows([b]) for n in me.blocks_of(capture_key(r["url"], r["page_id"]))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["block", "key"])

        def entries_of(block, rows):
            wanted = {r["key"] for r in rows}
            got = [tuple(e) for e in me.read_block(block) if e[0] in wanted]
            if got:
                yield entries(got)

        def records_of(file, rows):
            fs, base = open_fs(me.folder)
            with fs.open_input_file(f"{base}/{file}") as f:
                for r in sorted(rows, key=lambda r: r["offset"]):
                    headers, payload = parse_record(zlib.decompress(f.read_at(r["length"], r["offset"]), 31))
                    response = headers["WARC-Type"] == "response"
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{file} at {r['offset']}: the payload is not what its header says")
                    refers = headers.get("X-Refers-To-Page-ID")
                    cols = [[int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None], [headers["WARC-Type"]], [digest], [size], [int(refers) if refers else None], [payload if response else None]]
                    kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])

        asked = requests.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
        blocks = asked.mapInArrow(find, "block long, key string").distinct()
        wanted = bucketed(blocks, "block", entries_of, ENTRY)
        return bucketed(wanted, "file", records_of, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_pages(pages: DataFrame, folder: str | None = None) -> CaptureIndex:
    """Write pages (page_id, url, html) as archives with an index, in the shared folder unless told otherwise.

    A null html is an empty payload, a null url an empty one, a null page_id stays out of the header. Equal payloads of
    LEAST bytes or more are stored once, as the response of the smallest page_id; the others are revisits of it.
    Repeated rows of that page are responses all. An empty table gives an empty index; further columns are ignored."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return CaptureIndex.build(write_archives(plan_records(pages), folder), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, read back from the archives. A null or empty html is an empty payload and always response; of equal
    payloads the smallest page_id is response, repeated rows of that page too; an empty table gives no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = archive_pages(pages).read(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
