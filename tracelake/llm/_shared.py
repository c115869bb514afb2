"""What the operators share: the folder that all executors see, Arrow text buffers, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step works on at a time.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of SparkContext.setCheckpointDir, as a URI that Spark
    and pyarrow resolve alike. Where neither is set, local sessions get a temporary folder; others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tl_shared", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark._tl_shared = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)).rstrip("/").replace("file:///", "file:/").replace("file:/", "file:///")


def store(uri: str):
    """The pyarrow file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/tracelake-{uuid.uuid4().hex}-{name}"
    atexit.register(_remove, spark, path)
    return path


#: Rows of a table whose number of rows is known that a task writes, at least.
TASK_ROWS = 50_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs
    no more than the tasks after this table. ``rows``, a bound on the rows of df, keeps small tables from
    being written by as many tasks as there are shuffle partitions."""
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows and, where this Spark knows the setting, by bytes; a caller's own
    lower bounds stay."""
    for key, most in (("maxRecordsPerBatch", 4096), ("maxBytesPerBatch", 16 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        with contextlib.suppress(Exception):
            now = int(spark.conf.get(name, "0"))
            if not 0 < now <= most:
                spark.conf.set(name, str(most))


def release() -> None:
    """Hands freed memory back to the system: the Python workers of an executor share its limit with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget_codecs() -> None:
    """What tokenising tasks before have remembered in this worker goes: workers are used again, and what is remembered would
    add to the memory of other work. Tokenising tasks build it anew."""
    for name in ("bpe", "piece_bpe"):
        if (module := sys.modules.get(f"tracelake.llm.{name}")) is not None and module._CODECS:
            module._CODECS.clear()
            gc.collect()
    release()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Consecutive parts of batch whose text has at most ``limit`` bytes, or one row."""
    at = batch.schema.get_field_index(column)
    offsets = text_buffer(batch.column(at))[1]
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j
    release()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _lut(flagged) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(flagged)] = True
    return out


#: Bytes that are no part of a word: white space; or all but ASCII letters, digits and non-ASCII.
SPACE = _lut([0x20, *range(0x09, 0x0E)])
PUNCT = _lut([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside sep, and the row that each is in."""
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~sep[buf]
    edge = np.empty(n + 1, bool)  # a row begins or ends before this byte
    edge[:] = False
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The lowest k bytes of a 64-bit value.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than this are read one by one.
_LONG = 1024


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) + 1,), (1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time, each step through mix()."""
    if lower and len(buf):
        buf = LOWER[buf]
    eights, lengths = _eights(buf), ends - starts
    out = mix(lengths.astype(np.uint64) * _ODD + np.uint64(seed + 1))
    live = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    at, left = starts[live], lengths[live]
    while len(live):
        out[live] = mix(out[live] ^ (eights[at] & _LOW[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return out


def _same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each span has the same bytes as the span of number others[i]."""
    lengths = ends - starts
    out = lengths == lengths[others]
    eights = _eights(buf)
    live = np.flatnonzero(out & (lengths > 0) & (lengths <= _LONG) & (others != np.arange(len(others))))
    a, b, left = starts[live], starts[others[live]], lengths[live]
    while len(live):
        equal = (eights[a] ^ eights[b]) & _LOW[np.minimum(left, 8)] == 0
        out[live[~equal]] = False
        more = equal & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in np.flatnonzero(out & (lengths > _LONG)).tolist():
        j = int(others[i])
        out[i] = np.array_equal(buf[starts[i] : ends[i]], buf[starts[j] : ends[j]])
    return out


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each content, and for every span the number of its content in that list. Hashes only
    propose what is equal; the bytes decide."""
    keys = hash_spans(buf, starts, ends)
    first, where = np.unique(keys, return_index=True, return_inverse=True)[1:]
    odd = np.flatnonzero(~_same(buf, starts, ends, first[where]))
    while len(odd):  # equal hashes of different bytes: the least of what is left begins a content of its own
        heads, of = np.unique(keys[odd], return_index=True, return_inverse=True)[1:]
        where[odd] = len(first) + of
        first = np.concatenate([first, odd[heads]])
        odd = odd[~_same(buf, starts, ends, first[where])[odd]]
    return first, where


def hash_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given the words' hashes: runs of 1, 2, 4, ... words are hashed by pairs,
    and a run is put together from those that the bits of its length name."""
    lengths = ends - starts
    out, at = mix(lengths.astype(np.uint64) * _ODD + np.uint64(1)), starts.copy()
    level, k = words, 1
    while len(lengths) and k <= int(lengths.max()):
        has = np.flatnonzero(lengths & k)
        out[has] = mix(out[has] * _ODD + level[at[has]])
        at[has] += k
        level = mix(level[:-k] * _ODD + level[k:]) if len(level) > k else level[:0]
        k *= 2
    return out


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c in counts, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def unused(taken, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of ``taken``, whatever their case."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
    return out


def docs_only(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.col(c) for c in columns))


def by_least_hash(rows: DataFrame, column: str, most: int, distinct: bool = False) -> DataFrame:
    """rows whose 64-bit hash is below a bound that at least ``most`` of them (or of the distinct hashes)
    are expected to pass, about twice as many. So a sort for the least ``most`` holds a bounded number of
    rows, however many partitions there are. All rows, if there are not more."""
    counted = F.approx_count_distinct(column) if distinct else F.count(column)
    share = 2 * most / max(1, rows.agg(counted).first()[0])
    while share < 1:
        near = rows.filter(F.col(column) < F.lit(int(share * 2**64) - 2**63).cast("long"))
        if near.agg(F.count_distinct(column) if distinct else F.count(column)).first()[0] >= most:
            return near
        share *= 2
    return rows
