"""Ranked lexical search: the documents with the highest scores for each item, as a blocked sparse product.

The item-term matrix holds how often an item has a term, the term-document matrix the impact of a term in a
document, a 64-bit integer. Both are cut into blocks: items by bytes of their text, each block with a dictionary of
its own, documents by bytes of theirs.

1. Tasks write the item blocks to the shared folder.
2. One pass over the documents makes a row for each document block and item block: how often which term of the
   item block's dictionary is in which document, terms in order. The number of documents with a term, N, and of
   their terms, L, are sums over these rows, and so is each term's document frequency.
3. Tasks turn counts into impacts and multiply block by block: an item's result row is merged, in a dense row as
   wide as the document block, from the rows of the item's terms, each times its multiplicity (Gustavson's
   method). The k best of each item are kept over the blocks of a task, equal scores by ascending id.
4. A window ranks what the tasks kept: k rows of an item and task.

Terms are told apart by their bytes. A task holds one document block, one item block with its dictionary, and at
most HELD kept results; what is more goes on to step 4 at once.

Null text has no terms; an item or document without terms is in no result, nor is one with score 0. Rows are
items and documents of their own, so repeated rows give repeated results, each item row its own ranks. Null
ids of documents sort first among equal scores. An empty table on either side gives no rows. Extra columns do not
matter. Ids of documents must be integers, those of items may be of any type.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm._shared import LOWER, PUNCT, arrow_limits, cut, distinct_spans, ranges, scratch, slices, split_words, store, text_buffer

#: Bytes of text in a block of items, and in one of documents, but for single texts that are longer.
ITEM_BYTES, DOC_BYTES = 4 << 20, 4 << 20
#: Results that a task holds, at most.
HELD = 1 << 20
#: Fixed values of the score.
SATURATION, LENGTH_SHARE, SCALE = 8, 75, 1_000_000_000


class Items:
    """Rows of the item-term matrix: item i has the terms cols[edges[i]:edges[i + 1]], each as often as
    ``times`` says. Terms are numbers in the block's dictionary."""

    def __init__(self, texts: pa.Array, ids: pa.Array):
        buf, offsets = text_buffer(texts)
        buf = LOWER[buf]
        starts, ends, row = split_words(buf, offsets, PUNCT)
        first, where = distinct_spans(buf, starts, ends)
        self.ids, self.words, self.word_edges = ids, *_joined(buf, starts[first], ends[first])
        pairs, times = np.unique(row * max(len(first), 1) + where, return_counts=True)
        self.cols, self.times = pairs % max(len(first), 1), times.astype(np.int64)
        self.edges = np.searchsorted(pairs // max(len(first), 1), np.arange(len(ids) + 1))

    def __len__(self) -> int:
        return len(self.ids)

    def dump(self) -> bytes:
        ids = pa.BufferOutputStream()
        table = pa.table({"id": self.ids})
        with pa.ipc.new_stream(ids, table.schema) as out:
            out.write_table(table)
        whole = io.BytesIO()
        np.savez(whole, ids=np.frombuffer(ids.getvalue(), np.uint8), **{k: getattr(self, k) for k in ("words", "word_edges", "cols", "times", "edges")})
        return whole.getvalue()

    @classmethod
    def load(cls, content: bytes) -> Items:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(content)) as held:
            own.__dict__.update({k: held[k] for k in held.files})
        own.ids = pa.ipc.open_stream(own.ids.tobytes()).read_all().column("id").combine_chunks()
        return own

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each of the distinct words, -1 for those outside the dictionary."""
        n, shift = len(self.word_edges) - 1, len(self.words)
        both = np.concatenate([self.words, buf])
        of = distinct_spans(both, np.concatenate([self.word_edges[:-1], starts + shift]), np.concatenate([self.word_edges[1:], ends + shift]))[1]
        known = np.full(int(of.max(initial=-1)) + 1, -1)
        known[of[:n]] = np.arange(n)
        return known[of[n:]]


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans, one after another, and their edges."""
    sizes = ends - starts
    return buf[np.repeat(starts, sizes) + ranges(sizes)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def write_items(items: DataFrame, folder: str, text: str, item_id: str, limit: int) -> list[str]:
    """Writes the item blocks; returns their files, one per ``limit`` bytes of text or partition."""
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        files, root = store(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for part in slices(batch, "text", limit):
                path = f"{root}/{uuid.uuid4().hex}.npz"
                with files.open_output_stream(path, compression=None) as out:
                    out.write(Items(part.column(1), part.column(0)).dump())
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return sorted(r.path for r in rows.mapInArrow(run, "path string").collect())


_LOADED: dict[str, Items] = {}


def _items(files, path: str) -> Items:
    if path not in _LOADED:
        _LOADED.clear()
        with files.open_input_file(path) as f:
            _LOADED[path] = Items.load(f.read())
    return _LOADED[path]


#: A block of the term-document matrix, by terms: terms[i] is in counts[i] documents, which follow each other in docs and
#: tfs. docs are places in doc_ids and lengths. n_docs and n_terms count all documents, once a document block.
_BLOCK = [("block", T.IntegerType()), ("n_docs", T.LongType()), ("n_terms", T.LongType()), *((c, T.ArrayType(T.LongType())) for c in ("doc_ids", "lengths")), *((c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts", "docs", "tfs"))]


def _counted(docs: DataFrame, folder: str, paths: list[str], text: str, doc_id: str, limit: int) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        files, _ = store(folder)
        for batch in batches:
            for part in slices(batch, "text", limit):
                buf, offsets = text_buffer(part.column(1))
                buf = LOWER[buf]
                starts, ends, row = split_words(buf, offsets, PUNCT)
                lengths = np.bincount(row, minlength=part.num_rows)
                first, where = distinct_spans(buf, starts, ends)
                words, edges = _joined(buf, starts[first], ends[first])
                for block, path in enumerate(paths):
                    term = _items(files, path).numbers(words, edges[:-1], edges[1:])[where]
                    hit = term >= 0
                    pairs, tfs = np.unique(term[hit] * part.num_rows + row[hit], return_counts=True)
                    terms, counts = np.unique(pairs // part.num_rows, return_counts=True)
                    held, docs = np.unique(pairs % part.num_rows, return_inverse=True)
                    totals = (int((lengths > 0).sum()), int(lengths.sum())) if not block else (0, 0)
                    lists = [part.column(0).take(pa.array(held)), pa.array(lengths[held], pa.int64()), *(pa.array(x, pa.int32()) for x in (terms, counts, docs, tfs))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block], pa.int32()), *(pa.array([n], pa.int64()) for n in totals),
                        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists),
                    ], names=[name for name, _ in _BLOCK])

    return rows.mapInArrow(run, T.StructType([T.StructField(*c) for c in _BLOCK]))


def _weights(matrix: DataFrame, n_docs: int, folder: str) -> dict[int, str]:
    """Document frequencies of each item block's dictionary, turned into weights, a file each."""
    found = matrix.select("block", F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("block", "t.terms").agg(F.sum("t.counts").alias("df"))
    whole = found.groupBy("block").agg(F.collect_list("terms").alias("terms"), F.collect_list("df").alias("df"))  # one dictionary a row

    def run(batches):
        files, root = store(folder)
        for batch in batches:
            for block, terms, dfs in zip(*(c.to_pylist() for c in batch.columns)):
                out = np.zeros(max(terms) + 1, np.int64)
                out[terms] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in dfs]
                path = f"{root}/weights-{uuid.uuid4().hex}.npy"
                with files.open_output_stream(path, compression=None) as f:
                    whole = io.BytesIO()
                    np.save(whole, out)
                    f.write(whole.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([path])], names=["block", "path"])

    return {r.block: r.path for r in whole.mapInArrow(run, "block int, path string").collect()}


class _Best:
    """The k best results of each (block, item), equal scores by ascending id, null ids first."""

    def __init__(self, k: int):
        self.k, self.parts, self.held = k, [], 0

    def add(self, block: int, item: int, ids: np.ndarray, named: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:
            worst = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = np.flatnonzero(scores >= worst)
            near = near[np.lexsort((ids[near], named[near], -scores[near]))[: self.k]]
            ids, named, scores = ids[near], named[near], scores[near]
        self.parts.append((np.full(len(scores), block), np.full(len(scores), item), ids, named, scores))
        self.held += len(scores)

    def reduced(self) -> list[np.ndarray]:
        block, item, ids, named, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, named, -scores, item, block))
        block, item, ids, named, scores = (x[order] for x in (block, item, ids, named, scores))
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (item[1:] != item[:-1])])
        head = np.flatnonzero(new)
        top = np.arange(len(block)) - head[np.cumsum(new) - 1] < self.k
        out = [x[top] for x in (block, item, ids, named, scores)]
        self.parts, self.held = [tuple(out)], len(out[0])
        return out

    def batch(self) -> pa.RecordBatch:
        block, item, ids, named, scores = self.reduced()
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=~named), pa.array(scores, pa.int64())], names=["block", "item", "doc_id", "score"])


def multiply(items: Items, weights: np.ndarray, row: dict[str, np.ndarray], n_docs: int, n_terms: int):
    """(item, document places, scores above 0) of one item block times one document block."""
    lengths, terms, docs, tfs = row["lengths"], row["terms"], row["docs"], row["tfs"]
    norm = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n_docs // n_terms
    edges = np.concatenate([[0], np.cumsum(row["counts"])])
    impacts = np.repeat(weights[terms], row["counts"]) * (SCALE * tfs // (1000 * tfs + SATURATION * norm[docs]))
    at = np.full(len(items.word_edges), -1)
    at[terms] = np.arange(len(terms))
    merged = np.zeros(len(lengths), np.int64)
    for i in range(len(items)):
        a, b = items.edges[i], items.edges[i + 1]
        own = at[items.cols[a:b]]
        there = own >= 0
        if not there.any():
            continue
        for r, times in zip(own[there].tolist(), items.times[a:b][there].tolist()):
            merged[docs[edges[r] : edges[r + 1]]] += times * impacts[edges[r] : edges[r + 1]]
        found = np.flatnonzero(merged)
        yield i, found, merged[found]
        merged[found] = 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", item_bytes: int = ITEM_BYTES, doc_bytes: int = DOC_BYTES, held: int = HELD) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    arrow_limits(spark)
    folder = scratch(spark, "search")
    paths = write_items(items, folder, item_text, item_id, item_bytes)
    ids = items.schema[item_id].dataType
    matrix = cut(_counted(docs, folder, paths, text, doc_id, doc_bytes), "term_documents")
    n_docs, n_terms = matrix.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = _weights(matrix, n_docs, folder)
    columns = ["doc_ids", "lengths", "terms", "counts", "docs", "tfs"]

    def run(batches):
        files, _ = store(folder)
        best, known = _Best(k), {}
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(0)[r].as_py()
                if block not in known:
                    known.clear()
                    with files.open_input_file(weights[block]) as f:
                        known[block] = np.load(io.BytesIO(f.read()))
                values = {c: batch.column(1 + i)[r].values for i, c in enumerate(columns)}
                row = {c: np.asarray(x).astype(np.int64) for c, x in values.items() if c != "doc_ids"}
                named = np.asarray(values["doc_ids"].is_valid())
                own = np.asarray(values["doc_ids"].fill_null(0))
                for item, places, scores in multiply(_items(files, paths[block]), known[block], row, n_docs, n_terms):
                    good = scores > 0
                    places, scores = places[good], scores[good]
                    best.add(block, item, own[places], named[places], scores)
                if best.held > held:
                    best.reduced()
                    if best.held > held // 2:
                        yield best.batch()
        if best.parts:
            yield best.batch()

    kept = matrix.filter(F.size("terms") > 0).select("block", *columns).mapInArrow(run, "block int, item int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def named_ids(batches):
        files, _ = store(folder)
        for batch in batches:
            blocks, numbers = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for block in np.unique(blocks).tolist():
                at = pa.array(np.flatnonzero(blocks == block))
                names = _items(files, paths[block]).ids.take(pa.array(numbers[blocks == block]))
                part = batch.take(at)
                yield pa.RecordBatch.from_arrays([names, *(part.column(i) for i in (4, 2, 3))], names=["item_id", "rank", "doc_id", "score"])

    schema = T.StructType([T.StructField("item_id", ids), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return ranked.select("block", "item", "doc_id", "score", "rank").mapInArrow(named_ids, schema)
