"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Relationally: explode documents into n-grams, count them in tables partitioned by hash, join the
counts to the exploded n-grams, sum per document. A row for each n-gram would move the corpus many
times over, so rows are packed: documents are dealt into slices, a slice holds its n-grams exploded, and
sends each hash partition one sorted, delta-coded list of the distinct ones and their counts. The
partition is the count table of its n-grams: it adds up all lists and joins the totals to each of them, in
its order. The slice then has the count of every n-gram of its documents and sums their scores. The
orders are counted one after the other, so that the disk holds the lists of one order at a time: text
moves once for each order and once for the scores, an n-gram about once.

The score of a word is that of the longest n-gram, up to ORDER words, that ends with it and is found
MIN_COUNT times or more: log(count / count of its context), plus log(BACKOFF) for each order given
up. A single word has log(count / all words), whatever its count.

All counts are over all documents, the scored one included. Rows that share an id are one document:
their sums are added. A null id is an id like any other. Null text and text without words have
0 words, a log_score of 0 and no mean. Very frequent n-grams cost one entry a slice, so none is hot.
Only lists that hold something are sent, so there are never more of them than exploded rows; slices
and partitions grow in number with the corpus, not in size, but for a document longer than a slice.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm._shared import SPACE, arrow_limits, cut, hash_runs, hash_spans, split_words, text_buffer

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
SLICE_BYTES = 12 << 20
LEAST_BYTES = 2 << 20
#: Bytes of text for each hash partition.
PARTITION_BYTES = 24 << 20


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys, as differences of equal width."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[0] = 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + raw.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    steps = wide.view("<u8").reshape(-1).astype(np.uint64)
    steps[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(steps)


class Slice:
    """The n-grams of some documents, one order at a time."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        starts, ends, self.row = split_words(buf, offsets, SPACE)
        self.hashes = hash_spans(buf, starts, ends)
        self.words = len(starts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Last word of each n-gram of k words, hash of each."""
        last = np.arange(k - 1, self.words)
        last = last[self.row[last] == self.row[last - k + 1]] if k > 1 and len(last) else last
        return last, hash_runs(self.hashes, last - k + 1, last + 1)

    def list(self, k: int):
        """The sorted distinct hashes and their counts."""
        return np.unique(self.grams(k)[1], return_counts=True)

    def scores(self, totals: list[np.ndarray], n: int, rows: int, min_count: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Words and log score of each row. totals: the corpus counts of each order, aligned with list()."""
        score, below = np.zeros(self.words), np.zeros(self.words)
        for k, total in enumerate(totals, 1):
            last, keys = self.grams(k)
            counts, has = np.zeros(self.words), np.zeros(self.words, bool)
            if len(keys):
                counts[last] = total[np.unique(keys, return_inverse=True)[1]]
                has[last] = True
            if k == 1:
                score = np.log(np.maximum(counts, 1) / max(n, 1))
            elif self.words:
                context = np.concatenate([[1.0], below[:-1]])
                # A longer n-gram that is found replaces the score; one that is not costs a factor.
                score = np.where(has & (counts >= min_count), np.log(np.maximum(counts, 1) / np.maximum(context, 1)), score + np.where(has, math.log(backoff), 0.0))
            below = counts
        return np.bincount(self.row, minlength=rows), np.bincount(self.row, score, minlength=rows)


def _groups(batches, key: int, size: int):
    """Rows of consecutive batches, grouped by column ``key``; lists of tuples."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(size))):
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


@contextlib.contextmanager
def _freed(spark):
    """What runs in here removes its shuffle files at its end, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score_documents(docs: DataFrame, text: str = "text", doc: str = "doc_id", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score."""
    spark = docs.sparkSession
    arrow_limits(spark)
    own = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A small corpus has smaller slices, so that all cores have one.
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-size // slice_bytes), min(cores, size // LEAST_BYTES))
    bits = max(0, (size // PARTITION_BYTES).bit_length())
    dealt = own.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int"))

    ordered = dealt.select("slice", "doc", "text").repartition("slice").sortWithinPartitions("slice", "doc", "text")

    def count(k: int) -> DataFrame:
        """The corpus counts of order k for the lists of all slices."""

        def send(batches):
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            for number, rows in _groups(batches, 0, 3):
                keys, counts = Slice([r[2].encode() for r in rows]).list(k)
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else [0, len(keys)]
                parts = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
                out = [(p, number, pack(keys[a:b]), zstandard.compress(counts[a:b].astype("<u4").tobytes(), 1)) for p, a, b in parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)], names=["p", "slice", "keys", "counts"])

        def add(batches):
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            for p, rows in _groups(batches, 0, 4):
                lists = [(r[1], unpack(r[2]), np.frombuffer(zstandard.decompress(r[3]), "<u4")) for r in rows]
                keys = np.concatenate([x[1] for x in lists])
                where = np.unique(keys, return_inverse=True)[1]
                total = np.bincount(where, np.concatenate([x[2] for x in lists])).astype("<u8") if len(keys) else np.empty(0, "<u8")
                words, at, out = int(total.sum()) if k == 1 else 0, 0, []
                for number, own_keys, _ in lists:
                    answer = total[where[at : at + len(own_keys)]]
                    out.append((p, number, k, zstandard.compress(answer.tobytes(), 3), words))
                    at, words = at + len(own_keys), 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["p", "slice", "k", "totals", "words"])

        lists = ordered.mapInArrow(send, "p int, slice int, keys binary, counts binary")
        with _freed(spark):
            return cut(lists.repartition("p").sortWithinPartitions("p", "slice").mapInArrow(add, "p int, slice int, k int, totals binary, words long"), f"totals{k}")

    answers = count(1)
    n = answers.agg(F.sum("words")).first()[0] or 0
    for k in range(2, order + 1):
        answers = answers.union(count(k))
    blank = {"p": F.lit(None).cast("int"), "k": F.lit(None).cast("int"), "totals": F.lit(None).cast("binary"), "doc": F.lit(None).cast(own.schema["doc"].dataType), "text": F.lit(None).cast("string")}
    columns = ["slice", "p", "k", "totals", "doc", "text"]
    sides = [df.withColumns({c: v for c, v in blank.items() if c not in df.columns}).select(*columns, F.lit(i).alias("side")) for i, df in enumerate((answers.drop("words"), dealt))]
    schema = own.select(F.col("doc").alias("doc_id")).schema.add("n_words", "long").add("log_score", "double")

    def finish(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for _, rows in _groups(batches, 0, 7):
            texts = [r for r in rows if r[6] == 1]
            if not texts:
                continue
            totals = [np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(zstandard.decompress(r[3]), "<u8") for r in rows if r[6] == 0 and r[2] == k)]) for k in range(1, order + 1)]
            words, score = Slice([r[5].encode() for r in texts]).scores(totals, n, len(texts), min_count, backoff)
            yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in texts], kinds.field(0).type), pa.array(words, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_words", "log_score"])

    both = sides[0].union(sides[1]).repartition("slice").sortWithinPartitions("slice", "side", "p", "k", "doc", "text")
    by_row = both.mapInArrow(finish, schema)
    summed = by_row.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    return summed.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
