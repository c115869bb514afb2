"""WARC archives with a two-level capture index.

Archives: a gzip member for each record, in files that tasks write to the shared folder under names
of their own; a file counts only through the rows that its task returns, so a lost or repeated task
leaves nothing behind that is read. Payloads of at least MIN_REVISIT bytes that are equal are stored
once: the record with the smallest id is the response, the others are revisits that refer to it.

Index: captures are sorted by the key of their URL, the reversed host and the path as in CDX files,
then by page_id and place, and dealt to index files by ranges of that order, so that the captures of
one URL may fill many files. An index file holds compressed blocks of BLOCK_LINES sorted lines, key,
path, offset and length, then a sparse directory: the first key of each block and its place. A look-up
by key finds all index files whose range holds it, the blocks in each directory and the lines in each
block by binary search, and then reads only the ranges of the records.

Null html is an empty payload; a null url has the key ``-``. A null page_id never is what others
refer to; it is a revisit where an equal payload has an id. Rows that tie on the smallest id are all
responses. Extra columns are ignored, whatever their names. Empty tables give empty archives and an empty
index. A very long payload is one record, held whole by the task that writes or reads it. Page ids are integers.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm._shared import arrow_limits, cut, scratch, store as _store

MIN_REVISIT = 100
#: Bytes of an archive file, about.
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def url_key(url: Column) -> Column:
    """org,example,www)/path?query for http://www.example.org/path?query; ``-`` without a url."""
    rest = F.regexp_replace(url, "^[^:/?#]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(F.lower(host), "\\.")), ","), F.lit(")"), tail), F.lit("-"))


def plan(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    own = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # A payload too short for a revisit joins nothing: its key is null.
    keyed = own.withColumn("__k", F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("payload_digest")))
    first = keyed.filter("__k is not null").groupBy("__k").agg(F.min("page_id").alias("__first")).withColumnRenamed("__k", "__d")
    joined = keyed.join(first, F.col("__k") == F.col("__d"), "left")
    revisit = F.col("__first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("__first"), F.lit(False))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("__first"))}).drop("__k", "__d", "__first")


def record(page, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One uncompressed WARC/1.1 record."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = http if kind == "revisit" else http + payload
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(body))]) + "\r\n"
    return head.encode() + body + END


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if line)


def parse(raw: bytes) -> dict:
    """What a record says: page_id, payload_bytes, payload_digest (of a response's own bytes), record_type, refers_to, payload."""
    head, _, rest = raw.partition(END)
    fields = _headers(head)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(END)
    kind = fields["WARC-Type"]
    number = lambda k: int(x) if (x := fields.get(k, "<urn:page:>")[10:-1]) else None
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != said:
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": int(_headers(http)["Content-Length"]), "payload_digest": said,
        "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": None if kind == "revisit" else payload,
    }


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the records of plan(); returns the captures: key (of the URL), path, offset, length, page_id."""
    spark = planned.sparkSession
    arrow_limits(spark)
    rows = planned.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to", url_key(F.col("url")).alias("key"))

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            found = []
            for page, url, payload, digest, kind, refers_to, key in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                member = gzip.compress(record(page, url, payload.encode(), digest, kind, refers_to), 3, mtime=0)
                out.write(member)
                found.append((key, path, at, len(member), page))
                at += len(member)
            columns = list(zip(*found)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "path", "offset", "length", "page_id"])
        if out is not None:
            out.close()

    return cut(rows.mapInArrow(run, "key string, path string, offset long, length long, page_id long"), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the index files; returns one row for each: shard, first and last key, place of the directory."""
    order = ["key", "page_id", "path", "offset"]
    ordered = captures.select("key", "path", "offset", "length", "page_id").repartitionByRange(*order).sortWithinPartitions(*order).drop("page_id")

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, path, at, last, lines, directory = None, "", 0, "", [], []

        def flush():
            nonlocal at
            raw = zstandard.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(raw)
            directory.append((lines[0][0], at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.cdx"
                    out = store.open_output_stream(path, compression=None)
                lines.append(line)
                last = line[0]
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            raw = zstandard.compress(json.dumps(directory).encode())
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [path], "first": [directory[0][0]], "last": [last], "at": [at], "size": [len(raw)]})

    return cut(ordered.mapInArrow(run, "shard string, first string, last string, at long, size long"), "index")


class IndexFile:
    """One index file: its directory, and the last block that was read."""

    def __init__(self, store, path: str, at: int, size: int):
        self.file = store.open_input_file(path)
        self.blocks = json.loads(zstandard.decompress(self.file.read_at(size, at)))
        self.firsts = [b[0] for b in self.blocks]
        self.number, self.lines, self.keys = -1, [], []

    def find(self, key: str):
        """Path, offset and length of each record of a key."""
        # The block before the first that begins with the key may end with it.
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            if k != self.number:
                _, at, size = self.blocks[k]
                self.lines = [json.loads(x) for x in zstandard.decompress(self.file.read_at(size, at)).decode().split("\n")]
                self.keys, self.number = [x[0] for x in self.lines], k
            for line in self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                yield tuple(line[1:])


def read_records(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Looks up URL keys (column key, see url_key) and reads the records of all their captures: key,
    page_id, payload_bytes, payload_digest, record_type, refers_to. A key that the index does not hold
    gives no row, one that is asked for twice is looked up once."""
    spark = keys.sparkSession
    shards = sorted((r["first"], r["last"], r["shard"], r["at"], r["size"]) for r in index.collect())  # one short row a range partition
    held = spark.sparkContext.broadcast(([s[0] for s in shards], [s[1] for s in shards], shards))
    schema = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")][1:]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def deal(batches):
        """A row for each key and index file whose range holds it."""
        firsts, lasts, _ = held.value
        for batch in batches:
            found = [(k, key) for key in batch.column(0).to_pylist() if key is not None for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            columns = list(zip(*found)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string()))], names=["shard", "key"])

    def run(batches):
        store, _ = _store(folder)
        shards = held.value[2]
        number, shard, files = -1, None, {}

        def close():
            for file in files.values():
                file.close()
            files.clear()

        for batch in batches:
            places = []
            for k, key in zip(*(c.to_pylist() for c in batch.columns)):
                if k != number:
                    if shard is not None:
                        shard.file.close()
                    number, shard = k, IndexFile(store, *shards[k][2:])
                places += [(*place, key) for place in shard.find(key)]
            places.sort()
            for i in range(0, len(places), 4096):
                out = []
                for path, at, size, key in places[i : i + 4096]:
                    if path not in files:
                        if len(files) >= 16:
                            close()
                        files[path] = store.open_input_file(path)
                    said = parse(zlib.decompress(files[path].read_at(size, at), 31))
                    out.append((key, *(said[n] for n in names)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["key", *names])
        close()
        if shard is not None:
            shard.file.close()

    dealt = keys.select("key").distinct().mapInArrow(deal, "shard int, key string")
    # An index file is a task, whatever the share of one URL: the files' ranges hold about equally many captures.
    return dealt.repartitionById(max(1, len(shards)), F.col("shard")).sortWithinPartitions("shard", "key").mapInArrow(run, schema)


def look_up(urls: DataFrame, index: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """The records of all captures of URLs, as read_records()."""
    return read_records(urls.select(url_key(F.col(url)).alias("key")), index, folder)


def archive_and_read(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages to archives, indexes them, and reads every record back by the keys of the URLs."""
    folder = scratch(pages.sparkSession, "warc")
    captures = write_archives(plan(pages, page, url, html), folder)
    return read_records(captures, build_index(captures, folder), folder).drop("key")
