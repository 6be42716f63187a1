"""WARC archives with a two-level capture index.

Archives: each task writes its rows as gzip members of one file, a record a member, and reports where each lies.
Index: captures are sorted by their key, the URL with its host reversed, so a site's captures lie together. Each
index file holds blocks of compressed lines and ends with a sparse directory, the first key of each block. What is
known outside the files is one line for each index file, its first and last key.
Lookup: the file by its keys, the block by binary search in its directory, the lines by binary search in the block,
the record by a range read of the archive. The blocks of one key may be many, so they are dealt out again before
they are read.

Files are written under a folder all executors share, by any scheme that pyarrow.fs knows; their names are unique to
an attempt, and the list of captures, stored once, says which count. A lost executor leaves at most unlisted files.
"""

import base64
import bisect
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, shared_dir, stored, table

#: Payloads below this many bytes are always written whole.
LEAST_SHARED = 1000
#: Lines in a block of the index.
BLOCK_LINES = 2000
#: Bytes of records that a task reads, about, when all are looked up.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, archive string, at long, size long, kind string, digest string"
RECORD = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def capture_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL: scheme and fragment left out, the host (a-z) reversed; null is empty."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))
    return system, path


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode()


def record(page_id, url: str | None, payload: bytes, hexdigest: str, refers_to) -> bytes:
    """A response record, or a revisit of the response of page refers_to, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    digest = base64.b32encode(bytes.fromhex(hexdigest)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    fields.append(("Content-Length", str(len(body))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + _header(fields) + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """The fields of a record's gzip member; payload is that of a response, checked against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {fields.get('X-Page')} doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": len(payload) if response else number("X-Payload-Length"), "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page"), "payload": payload if response else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, out, at = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = {k: [] for k in ("key", "page_id", "archive", "at", "size", "kind", "digest")}
            for x in batch.to_pylist():
                out = out or system.open_output_stream(name, compression=None)
                member = record(x["page_id"], x["url"], (x["html"] or "").encode(), x["digest"], x["refers_to"])
                out.write(member)
                for k, v in (("key", x["key"]), ("page_id", x["page_id"]), ("archive", name), ("at", at), ("size", len(member)), ("kind", "response" if x["refers_to"] is None else "revisit"), ("digest", x["digest"])):
                    rows[k].append(v)
                at += len(member)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); the captures: where each lies.

    Of rows with equal payloads of LEAST_SHARED bytes or more the one with the largest page_id is written whole and
    the others refer to it.
    """
    _make(folder)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    # computed by itself, so that only digests are grouped
    large = rows.where(F.octet_length(html) >= LEAST_SHARED)
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # small payloads refer to nothing and stay where they are; so do large ones while the shared digests are few
    large = beside(large, stored(last, "shared"), "digest").withColumn("refers_to", F.when(F.col("last") != F.col("page_id"), F.col("last"))).drop("last")
    small = rows.where(F.octet_length(html) < LEAST_SHARED).withColumn("refers_to", F.lit(None).cast("long"))
    rows = small.unionByName(large)
    return stored(rows.select("page_id", "url", "html", "digest", "refers_to", capture_key(F.col("url")).alias("key")).mapInArrow(_write(folder), CAPTURE), "captures")


def _make(folder: str) -> None:
    system, path = _open(folder)
    system.create_dir(path, recursive=True)


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        name, out, at, directory, lines, last, total = f"{path}/{uuid.uuid4().hex}.idx", None, 0, [], [], "", 0

        def flush() -> None:
            nonlocal at, lines, out
            out = out or system.open_output_stream(name, compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at += len(block)
            lines = []

        for batch in batches:
            for x in batch.to_pylist():
                last = x["key"]
                total += x["size"]
                lines.append([x["key"], x["archive"], x["at"], x["size"]])
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out:
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([total])], ["file", "first_key", "last_key", "bytes"])

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures by key into index files; (file, first_key, last_key, bytes of its records) of each. Ties by
    page_id, so that a key with very many captures is spread too."""
    _make(folder)
    ordered = captures.repartitionByRange("key", "page_id", "at").sortWithinPartitions("key", "page_id", "archive", "at")
    return stored(ordered.select("key", "archive", "at", "size").mapInArrow(_index(folder), "file string, first_key string, last_key string, bytes long"), "index")


class _Reader:
    """Range reads of files that stay open while they are used in turn."""

    def __init__(self, folder: str):
        self.system, self.files = _open(folder)[0], {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(name)
        return self.files[name].read_at(size, at)

    def tail(self, name: str) -> list:
        size = self.system.get_file_info(name).size
        n = int.from_bytes(self.read(name, size - 8, 8), "big")
        return json.loads(zlib.decompress(self.read(name, size - 8 - n, n)))


def _find(files, folder: str):
    """Of each key the blocks that may hold it. Keys ascend, as the files do, so that each file's directory is read once
    and one is held at a time: of the files that a key lies in only the last can hold the next key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, directory, firsts = _Reader(folder), None, [], []
        known = files.value
        lasts = [x[2] for x in known]
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                k = bisect.bisect_left(lasts, key)  # the first file whose last key isn't smaller
                while k < len(known) and known[k][1] <= key:
                    if known[k][0] != name:
                        name = known[k][0]
                        directory = reader.tail(name)
                        firsts = [x[0] for x in directory]
                    lo = max(0, bisect.bisect_left(firsts, key) - 1)
                    hi = bisect.bisect_right(firsts, key)
                    rows += [(key, name, at, size) for _, at, size in directory[lo:hi]]
                    k += 1
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "size"])

    return run


def _fetch(folder: str):
    """Reads each block once for its keys, and the records of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, lines, keys = _Reader(folder), None, [], []
        for batch in batches:
            rows, size = [], 0
            for x in batch.to_pylist():
                if held != (x["file"], x["at"]):
                    held = (x["file"], x["at"])
                    lines = [json.loads(y) for y in zlib.decompress(reader.read(x["file"], x["at"], x["size"])).decode().split("\n")]
                    keys = [y[0] for y in lines]
                for _, archive, at, n in lines[bisect.bisect_left(keys, x["key"]) : bisect.bisect_right(keys, x["key"])]:
                    rows.append({"key": x["key"], **parsed(reader.read(archive, at, n))})
                    size += rows[-1]["payload_bytes"] or 0
                    if size > 8 << 20:
                        yield _records(rows)
                        rows, size = [], 0
            yield _records(rows)

    return run


def _records(rows: list[dict]) -> pa.RecordBatch:
    types = {"key": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in types.items()], list(types))


def lookup(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """The records of all captures of the keys (key string): see RECORD. Keys that aren't there give no rows."""
    # as many rows as index files
    files = sorted(map(tuple, index.select("file", "first_key", "last_key", "bytes").collect()), key=lambda x: (x[1], x[2]))
    told = keys.sparkSession.sparkContext.broadcast(files)
    ordered = keys.select("key").where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = ordered.mapInArrow(_find(told, folder), "key string, file string, at long, size long")
    # a given number, as the rows dealt here say nothing of the records behind them
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x[3] for x in files) // TASK_BYTES)
    blocks = blocks.repartition(tasks, "file", "at").sortWithinPartitions("file", "at", "key")
    return blocks.mapInArrow(_fetch(folder), RECORD)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index of pages under a new folder; (captures, index, folder).

    A null html is an empty payload, a null url has the key `)`. Equal rows are one record each; with one page_id
    none refers to the other. A payload is held whole, once packed and once not, by the task that
    writes or reads it. Further columns are ignored. No rows: no files, and lookups find nothing.
    """
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    return captures, write_index(captures, folder), folder


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, index, folder = archived(spark, pages)
    got = lookup(pages.select(capture_key(F.col("url")).alias("key")), index, folder)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM q
"""
