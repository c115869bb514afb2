"""Benchmark decontamination with suffix arrays over the training text.

Each shard (the documents of an Arrow batch, up to SHARD_BYTES) gets a suffix array over its words,
sorted by prefix doubling to the length of a window. Every suffix of every benchmark item that begins a
window is then found by binary search in it. A window is WINDOW consecutive words of an item; an item
of fewer words, but not none, is one window. Equal windows are searched once. The positions in the found
range of the array are verbatim matches; runs of them on one diagonal give the longest match of a document.

No shuffle is needed: a match lies within a document. The benchmark is the stated query set. Tasks
write it to the shared folder in blocks of at most BLOCK_BYTES of text (or one item), and a shard's
array, built once, is searched for one block after the other; a worker holds one block at a time, so
what is held at once doesn't grow with the benchmark.

Null text has no words: such a document has no hit, such an item no window. A null item_id counts as
the id ''. Items that repeat an id count once. Empty tables give no rows or no hits. Repeated rows are
judged one by one. A text longer than a shard is a shard of its own, never cut. Extra columns stay;
find_matches() replaces those named like its results, decontaminate() returns all as they were.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm._shared import LOWER, PUNCT, arrow_limits, hash_spans, ranges, scratch, slices, split_words, store, text_buffer

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Matches, one for each item that a window is in, that are held at once.
MATCHES = 1 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and their rows. No hash is 0, which stands for the end of a row."""
    starts, ends, row = split_words(buf, offsets, PUNCT)
    return np.maximum(hash_spans(LOWER[buf] if len(buf) else buf, starts, ends), np.uint64(1)), row


class SuffixArray:
    """Word suffixes in the order of their first ``depth`` words; a suffix ends with its row. Suffixes that
    share these words have the same rank."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, depth: int):
        n = len(words)
        self.words, self.row = words, row
        self.end = np.cumsum(np.bincount(row, minlength=rows))[row] if n else row
        rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        order, k, at = np.argsort(rank, kind="stable"), 1, np.arange(n)
        while k < depth and n:
            step = min(k, depth - k)
            after = np.zeros(n, np.int64)
            inside = at + step < self.end
            after[inside] = rank[at[inside] + step]
            key = rank << 32 | after
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
            k += step
        self.order, self.rank = order, rank

    def _below(self, at: np.ndarray, patterns: Patterns, inclusive: bool) -> np.ndarray:
        """Whether the suffix at each position sorts before the pattern (or, inclusive, begins with it)."""
        undecided, below = np.ones(len(at), bool), np.zeros(len(at), bool)
        for j in range(patterns.width):
            live = np.flatnonzero(undecided & (j < patterns.length))
            if not len(live):
                break
            where = at[live] + j
            inside = where < self.end[at[live]]
            have = np.zeros(len(live), np.uint64)
            have[inside] = self.words[where[inside]]
            want = patterns.words[patterns.start[live] + j]
            below[live] = have < want
            undecided[live] = have == want
        return below | undecided if inclusive else below

    def ranges(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the part of the array whose suffixes begin with it, by binary search."""
        found = []
        for inclusive in (False, True):
            low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.order), np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                below = self._below(self.order[np.minimum(middle, len(self.order) - 1)], patterns, inclusive)
                low = np.where(open_ & below, middle + 1, low)
                high = np.where(open_ & ~below, middle, high)
            found.append(low)
        return found[0], found[1]


class Patterns:
    """The distinct windows of some items: slices of one array of words, and the places that each has in them."""

    def __init__(self, texts: list[str | None], ids: list[str], window: int):
        buf, offsets = text_buffer(pa.array([t or "" for t in texts], pa.large_string()))
        self.words, row = words_of(buf, offsets)
        counts = np.bincount(row, minlength=len(texts))
        begin = np.cumsum(counts) - counts
        windows = np.where(counts >= window, counts - window + 1, (counts > 0).astype(counts.dtype))
        item = np.repeat(np.arange(len(texts)), windows)
        place = begin[item] + ranges(windows)
        # Suffixes of one rank share their first ``window`` words, and the end of the item if that comes first.
        rank = SuffixArray(self.words, row, len(texts), window).rank
        _, first, group = np.unique(rank[place], return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")
        self.start = place[first]
        self.length = np.minimum(counts, window)[item[first]]
        self.width = int(self.length.max()) if len(self.length) else 0
        #: Places and items of group g: from edges[g] to edges[g + 1]. Places leave a gap between items.
        self.places, self.items = (place + item)[by_group], item[by_group]
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
        self.ids = ids

    def __len__(self) -> int:
        return len(self.start)

    ARRAYS = ("words", "start", "length", "places", "items", "edges")

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=np.array([i.encode() for i in self.ids], object).astype(bytes) if self.ids else np.empty(0, "S1"), **{a: getattr(self, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Patterns:
        held = np.load(io.BytesIO(raw))
        out = cls.__new__(cls)
        for a in cls.ARRAYS:
            setattr(out, a, held[a])
        out.ids = [i.decode() for i in held["ids"].tolist()]
        out.width = int(out.length.max()) if len(out.length) else 0
        return out


def write_blocks(benchmark: DataFrame, folder: str, text: str = "text", item: str = "item_id", window: int = WINDOW, limit: int = BLOCK_BYTES) -> list[str]:
    """Tasks write the benchmark's windows to files, a block each; their paths, one for each ``limit`` bytes or less."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")), F.col(f"`{text}`")).filter(F.col(f"`{text}`").isNotNull())

    def run(batches):
        files, root = store(folder)
        files.create_dir(root, recursive=True)

        def flush(texts, ids):
            path = f"{root}/{uuid.uuid4().hex}.npz"
            with files.open_output_stream(path, compression=None) as out:
                out.write(Patterns(texts, ids, window).dump())
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        texts, ids, size = [], [], 0
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                if texts and size + len(body) > limit:
                    yield flush(texts, ids)
                    texts, ids, size = [], [], 0
                texts.append(body)
                ids.append(name)
                size += len(body)
        if texts:
            yield flush(texts, ids)

    return sorted(r.path for r in rows.mapInArrow(run, "path string").collect())


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The union of intervals, as disjoint ones."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return [{"start": a, "end": b} for a, b in zip(starts[new].tolist(), ends[last].tolist())]


def _longest(place: np.ndarray, group: np.ndarray, patterns: Patterns) -> int:
    """Words of the longest verbatim match of one document: the longest run of places on one diagonal with an
    item. Place by place, with what is open at one place held."""
    best, before, opened, begun = 0, -2, np.empty(0, np.int64), np.empty(0, np.int64)
    for p, g in zip(place.tolist(), group.tolist()):
        at = np.sort(patterns.places[patterns.edges[g] : patterns.edges[g + 1]])
        since = np.full(len(at), p)
        if before == p - 1 and len(opened):
            i = np.minimum(np.searchsorted(opened, at - 1), len(opened) - 1)
            goes_on = opened[i] == at - 1
            since[goes_on] = begun[i[goes_on]]
        best = max(best, p + int(patterns.length[g]) - int(since.min()))
        before, opened, begun = p, at, since
    return best


def _longest_of_rows(of: np.ndarray, place: np.ndarray, group: np.ndarray, patterns: Patterns) -> dict[int, int]:
    """_longest() of all rows at once."""
    sizes = patterns.edges[group + 1] - patterns.edges[group]
    which = np.repeat(np.arange(len(of)), sizes)
    at = patterns.places[patterns.edges[group][which] + ranges(sizes)]
    of, place, length, diagonal = of[which], place[which], patterns.length[group][which], place[which] - at
    order = np.lexsort((place, diagonal, of))
    of, place, length, diagonal = of[order], place[order], length[order], diagonal[order]
    first = np.concatenate([[True], (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)])
    head = np.flatnonzero(first)
    last = np.append(head[1:] - 1, len(of) - 1)
    out: dict[int, int] = {}
    for row, n in zip(of[head].tolist(), (place[last] + length[last] - place[head]).tolist()):
        out[row] = max(out.get(row, 0), n)
    return out


class Shard:
    """The words of some texts and their suffix array."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int):
        rows = len(offsets) - 1
        words, row = words_of(buf, offsets)
        self.counts = np.bincount(row, minlength=rows)
        self.index = SuffixArray(words, row, rows, window)

    def search(self, patterns: Patterns) -> dict[int, tuple]:
        """For rows with hits their spans, item ids and longest match in words."""
        if not len(self.index.words) or not len(patterns):
            return {}
        low, high = self.index.ranges(patterns)
        n = high - low
        group = np.repeat(np.arange(len(patterns)), n)
        at = self.index.order[np.repeat(low, n) + ranges(n)]
        order = np.argsort(at, kind="stable")
        at, group = at[order], group[order]
        of = self.index.row[at]
        place = at - (np.cumsum(self.counts) - self.counts)[of]
        length = patterns.length[group]
        work = np.cumsum(patterns.edges[group + 1] - patterns.edges[group])
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        out, i = {}, 0
        while i < len(edges) - 1:
            a = int(edges[i])
            most = (int(work[a - 1]) if a else 0) + MATCHES
            j = max(i + 1, int(np.searchsorted(work[edges[1:] - 1], most, side="right")))
            b = int(edges[j])
            whole = int(work[b - 1]) <= most
            longest = _longest_of_rows(of[a:b], place[a:b], group[a:b], patterns) if whole else {int(of[a]): _longest(*self._once(place[a:b], group[a:b], length[a:b]), patterns)}
            for c, d in zip(edges[i:j].tolist(), edges[i + 1 : j + 1].tolist()):
                own = np.unique(group[c:d])
                items: set[int] = set()
                for g in own.tolist():
                    items.update(patterns.items[patterns.edges[g] : patterns.edges[g + 1]].tolist())
                out[int(of[c])] = _merge(place[c:d], place[c:d] + length[c:d]), {patterns.ids[x] for x in items}, longest[int(of[c])]
            i = j
        return out

    @staticmethod
    def _once(place: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One window a place, the longest: shorter ones are whole items, whose matches end there."""
        order = np.lexsort((-length, place))
        first = np.concatenate([[True], place[order][1:] != place[order][:-1]])
        return place[order][first], group[order][first]


RESULTS = {"n_words": T.LongType(), "spans": T.ArrayType(SPAN), "item_ids": T.ArrayType(T.StringType()), "longest_match": T.LongType()}


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (disjoint intervals of hit words), item_ids (sorted), longest_match (words)
    and contaminated."""
    spark = docs.sparkSession
    arrow_limits(spark)
    names = [c for c in docs.columns if c not in RESULTS and c != "contaminated"]
    at = names.index(text)
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in RESULTS.items())])
    folder = scratch(spark, "benchmark")
    paths = write_blocks(benchmark, folder, item_text, item_id, window, block_bytes)

    def run(batches):
        files, _ = store(folder)
        for batch in batches:
            for part in slices(batch, text, SHARD_BYTES):
                shard = Shard(*text_buffer(part.column(at)), window)
                spans, items, longest = [[] for _ in shard.counts], [[] for _ in shard.counts], [0] * len(shard.counts)
                for path in paths:
                    for r, (own, ids, long) in shard.search(_load(files, path)).items():
                        both = [*spans[r], *own]
                        spans[r] = _merge(np.array([s["start"] for s in both]), np.array([s["end"] for s in both]))
                        items[r] = sorted({*items[r], *ids})
                        longest[r] = max(longest[r], long)
                made = (shard.counts.tolist(), spans, items, longest)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, t in zip(made, ARROW))], names=[*names, *RESULTS])

    return docs.mapInArrow(run, schema).withColumn("contaminated", F.size("spans") > 0)


_LOADED: dict[str, Patterns] = {}


def _load(files, path: str) -> Patterns:
    if path not in _LOADED:
        _LOADED.clear()
        with files.open_input_file(path) as f:
            _LOADED[path] = Patterns.load(f.read())
    return _LOADED[path]


ARROW = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.int64())


def hit_words(spans: str = "spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs without a verbatim match, with their own columns."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = find_matches(docs.select(own, F.col(f"`{text}`").alias("text")), benchmark, **options)
    return found.filter(~F.col("contaminated")).select("row.*")
