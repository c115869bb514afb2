"""Substring de-duplication: FM-indexes per shard and matching statistics of the documents' passages.

A window is WINDOW consecutive words of a document. Each word in a window that also starts in a
document with a smaller id is removed; windows are judged on the input.

Streaming every document against every shard would grow with the square of the corpus, so passages
are routed. The least hash of the GRAM-word runs inside a window, its anchor, depends only on the
window's words: equal windows have equal anchors. A segment is a run of windows with one anchor.

1. Anchors are counted; one that a single document holds cannot have a match elsewhere.
2. Equal segments of an anchor (128-bit keys) are told once for the document with the least id and once for one of
   the others, if there are others; what is found for that one holds for all others.
3. All these go to shards by anchor. A shard builds an FM-index over its segments
   (word BWT in a wavelet matrix) and streams them through backward search. Where the matching
   statistics reach WINDOW words, the range's least document decides about the window. Nothing is removed that was
   not found there, but for windows of step 4.
4. Anchors with more than HOT occurrences are spread over several shards by content. Their shards
   also report their windows' keys (128 bits), and the least document of equal windows is found
   over all of them.
5. Intervals join the documents again, which drop the words that they cover.

A shard holds at most SHARD_BYTES of text plus one anchor's part. Nothing is capped or dropped.

Joins on a frequent anchor or content have it on one side only many times, so adaptive execution can split
that side. Null text has no words; an empty table gives no rows; a very long text is cut into segments like
any other. Ids must be integers or cast to them. Rows without an id are neither searched nor searched for, and stay whole.
Rows that share an id are one document to the search: each of them loses its own repeated windows,
none because of the other. Where their texts differ, a hash of the text tells them apart. Extra columns stay, except those named like the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm._shared import SPACE, arrow_limits, as_long, cut, forget_codecs, hash_runs, hash_spans, mix, ranges, release, slices, split_words, text_buffer, unused
from tracelake.llm.fm_index import FMIndex

WINDOW = 50
GRAM = 8
#: Windows of a segment at most; longer runs of one anchor are several segments.
LONGEST = 64
#: Occurrences from which an anchor is spread over several shards, and the size of a part.
HOT = 200
SHARD_BYTES = 1 << 20
#: Bytes of text that are split into words together.
TEXT_BYTES = 1 << 20


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    rest = width - k
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(words: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all rows' segments: anchor, row, first word (in the joined words), windows, two hashes of the content."""
    n = len(words)
    empty = np.empty(0, np.int64)
    if n < window:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = hash_runs(words, np.arange(n - gram + 1), np.arange(gram, n + 1))
    least = _sliding_least(grams, window - gram + 1)
    start = np.flatnonzero(row[window - 1 :] == row[: n - window + 1])
    anchor, of = least[start], row[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])])[: len(start)]
    run = np.flatnonzero(new)
    sizes = np.diff(np.append(run, len(start)))
    parts = -(-sizes // LONGEST)
    head = np.repeat(run, parts) + ranges(parts) * LONGEST
    count = np.minimum(LONGEST, np.repeat(run + sizes, parts) - head)
    first = start[head]
    stop = first + count + window - 1
    return anchor[head], of[head], first, count, hash_runs(words, first, stop), hash_runs(mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, stop)


def _words(part: pa.RecordBatch, at: int):
    buf, offsets = text_buffer(part.column(at))
    starts, ends, row = split_words(buf, offsets, SPACE)
    begin = np.searchsorted(row, np.arange(len(offsets)))
    return buf, starts, ends, row, begin


def occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, content, twin, doc, version, first (word of the document), n (windows) of every segment. docs:
    doc, text, version. content and twin, 128 bits together, name the segment's words."""

    def run(batches):
        forget_codecs()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                buf, starts, ends, row, begin = _words(part, 1)
                anchor, of, first, n, content, twin = segments(hash_spans(buf, starts, ends), row, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(as_long(x)) for x in (anchor, content, twin)), *(part.column(k).take(pa.array(of)) for k in (0, 2)), pa.array(first - begin[of], pa.int32()), pa.array(n, pa.int32())],
                    names=["anchor", "content", "twin", "doc", "version", "first", "n"],
                )

    return docs.filter("doc is not null and text is not null").mapInArrow(run, "anchor long, content long, twin long, doc long, version long, first int, n int")


def _cut_out(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of each representative segment, joined by single spaces."""
    lists = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "part", "hot", "content", "twin", "first", "n")).alias("s"))
    joined = docs.join(lists, ["doc", "version"]).select("doc", "text", "s")
    fields = ["anchor", "part", "hot", "content", "twin", "doc", "first", "n"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                buf, starts, ends, row, begin = _words(part, 1)
                raw = buf.tobytes()
                out = []
                for r, (doc, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    low, high = int(begin[r]), int(begin[r + 1])
                    words = raw[starts[low] : ends[high - 1]].split() if high > low else []
                    for s in found:
                        text = words[s["first"] : s["first"] + s["n"] + window - 1]
                        if len(text) == s["n"] + window - 1:
                            out.append((s["anchor"], s["part"], s["hot"], s["content"], s["twin"], doc, s["first"], s["n"], b" ".join(text)))
                columns = list(zip(*out)) if out else [[]] * 9
                types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*fields, "words"])

    return joined.mapInArrow(run, "anchor long, part int, hot boolean, content long, twin long, doc long, first int, n int, words binary")


def search(shards: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Streams the segments of each shard through the FM-index of that shard. kind 0: windows at and up to
    ``end`` of a segment occur in a smaller document; kind 1: a window of a hot anchor with its key."""
    spread = shards.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    schema = "kind int, anchor long, content long, twin long, doc long, at int, end int, k1 long, k2 long"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def settle(rows: list[tuple], texts: list[bytes]):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, ends, row = split_words(buf, offsets, SPACE)
        words = hash_spans(buf, starts, ends)
        lengths = np.bincount(row, minlength=len(texts))
        own = [np.array([r[k] for r in rows], np.int64) for k in (0, 3, 4, 5)]
        docs = own[3]
        index = FMIndex(words, lengths, docs, window)
        found, least = index.matching_statistics(words, lengths)
        hit = (found >= window) & (least < docs[row])
        del index, found, least
        begin = np.cumsum(lengths) - lengths
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        # A run of hits ends with its segment, though the next one may begin with a hit.
        heads = np.flatnonzero((edge[:-1] == 1) | (hit & (np.arange(len(hit)) == begin[row])))
        stops = np.minimum(np.flatnonzero(edge == -1)[np.searchsorted(np.flatnonzero(edge == -1), heads, side="right")], (begin + lengths)[row[heads]])
        of = row[heads]
        yield _columns(0, [x[of] for x in own], heads - begin[of], stops - begin[of], None)
        hot = np.array([r[2] for r in rows], bool)
        if not hot.any():
            return
        windows = np.where(hot, lengths - window + 1, 0)
        of, at = np.repeat(np.arange(len(rows)), windows), ranges(windows)
        twin = hash_spans(buf, starts, ends, seed=1)
        for i in range(0, len(of), 1 << 16):
            r, w = of[i : i + (1 << 16)], at[i : i + (1 << 16)]
            first = begin[r] + w
            yield _columns(1, [x[r] for x in own], w, w + 1, [hash_runs(x, first, first + window) for x in (words, twin)])

    def _columns(kind: int, own: list, at: np.ndarray, end: np.ndarray, keys: list | None) -> pa.RecordBatch:
        keys = [pa.array(as_long(k)) for k in keys] if keys else [pa.nulls(len(at), pa.int64())] * 2
        columns = [np.full(len(at), kind), *own, at, end]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), *keys], names=names)

    def run(batches):
        forget_codecs()
        rows, texts, size = [], [], 0

        for batch in batches:
            raw, offsets = text_buffer(batch.column(8))
            body = raw.tobytes()
            for r, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
                if size > shard_bytes and rows[-1][:2] != row[:2]:
                    yield from settle(rows, texts)
                    rows, texts, size = [], [], 0
                    release()
                rows.append(row)
                texts.append(body[offsets[r] : offsets[r + 1]])
                size += len(texts[-1])
        if rows:
            yield from settle(rows, texts)
        release()

    return spread.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc, version, spans: intervals of word numbers to remove, for the documents that have some, by doc and
    version (a hash of the text). docs: doc, text, version."""
    named = ["anchor", "content", "twin"]
    seen = cut(occurrences(docs, window, gram), "occurrences")
    held = seen.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("k")).filter("lo != hi").select("anchor", "k")
    flagged = cut(seen.join(held, "anchor"), "flagged")
    one = F.struct("doc", "version", "first", "n")
    contents = flagged.groupBy(*named).agg(F.min(one).alias("head"), F.max(one).alias("tail"), F.max("k").alias("k"))
    contents = cut(contents.withColumn("copied", F.col("head.doc") != F.col("tail.doc")), "contents")
    parts = F.when(F.col("k") > hot, F.pmod("content", F.ceil(F.col("k") / hot))).otherwise(0).cast("int")
    both = F.explode(F.when(F.col("copied"), F.array("head", "tail")).otherwise(F.array("head"))).alias("s")
    wanted = contents.select("anchor", parts.alias("part"), (F.col("k") > hot).alias("hot"), "content", "twin", both).select("anchor", "part", "hot", "content", "twin", "s.*")
    found = cut(search(_cut_out(wanted, docs, window), window), "found")
    keyed = found.filter("kind = 1")
    least = keyed.groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low != high").select("k1", "k2", "low")
    across = keyed.join(least, ["k1", "k2"]).filter("low < doc").select(*named, "doc", "at", "end")
    windows = found.filter("kind = 0").select(*named, "doc", "at", "end").union(across)
    # What was found for the least document with a content holds for its segments, what was found for another one for all others.
    owners = contents.select(*named, F.col("head.doc").alias("owner"))
    windows = windows.join(owners, named).select(*named, "owner", (F.col("doc") > F.col("owner")).alias("later"), "at", "end")
    hits = flagged.select(*named, "doc", "version", "first").join(windows, named).filter((F.col("doc") > F.col("owner")) == F.col("later"))
    spans = hits.select("doc", "version", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("end") + window - 1).alias("stop"))
    return spans.groupBy("doc", "version").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))


RESULTS = ("n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, text: str = "text", doc: str = "doc_id", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed and kept: the words that stay, joined by one space."""
    arrow_limits(docs.sparkSession)
    names = [c for c in docs.columns if c not in RESULTS]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    plain = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("version"))
    own, version, found = unused(names, "__doc", "__version", "__spans")
    spans = repeated_spans(plain, window, gram, hot).withColumnsRenamed({"doc": own, "version": version, "spans": found})
    joined = docs.join(spans, (F.col(f"`{doc}`").cast("long") == F.col(own)) & (F.xxhash64(f"`{text}`") == F.col(version)), "left").drop(own, version)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                buf, starts, ends, row, begin = _words(part, at)
                raw = buf.tobytes()
                counts, removed, kept = np.diff(begin), [], []
                for r, spans in enumerate(part.column(len(names)).to_pylist()):
                    low, high = int(begin[r]), int(begin[r + 1])
                    words = raw[starts[low] : ends[high - 1]].split() if high > low else []
                    if spans:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, [min(s["first"], len(words)) for s in spans], 1)
                        np.add.at(edge, [min(s["stop"], len(words)) for s in spans], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    removed.append(int(counts[r]) - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, *RESULTS])

    return joined.mapInArrow(run, schema)
