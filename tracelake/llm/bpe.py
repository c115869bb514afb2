"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Pre-tokenising uses no regular expression. Each code point gets a class from a table; look-ahead of at most two
characters refines apostrophes (does a contraction start here?) and white space (is it the last of
its run?). Every class is a function from scanner states to scanner states. Functions compose
associatively and their closure under composition is small, so a batch is scanned in blocks: the
product of each block, then the products before each block, then the states inside all blocks at
once. A start of a token is a property of (state before, class).

The slices between starts feed pair merging by rank. Distinct slices, told apart by their bytes, are merged
once and remembered.
Ids come with the byte offset of each token, so any range of ids decodes to a range of the text.

Null text counts as empty: no ids. Rows are independent, so repeated rows and ties give equal results;
extra columns stay, except those named like the results. An empty table gives no rows. Texts are encoded
whole, however long, and long slices merge in O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm._shared import arrow_limits, distinct_spans, ranges, slices, text_buffer

# Classes. Each has a twin, + ROW, for the first character of a row, which forgets what came before.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, SPACE, GAP, SAME = range(9)
ROW = 9
# States: a new token must start; inside a run; after a space that joins what follows; in a contraction.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINING, ONE_LEFT, TWO_LEFT = range(8)
#: Columns of characters in a block of the scan.
BLOCK = 64
#: Distinct slices that a task remembers.
REMEMBERED = 1 << 19
#: From this length on a slice is merged with a heap.
HEAP_FROM = 96
#: Bytes of a slice that is remembered, at most.
LONGEST_REMEMBERED = 256


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a character, and whether a token starts at it."""
    if kind == SAME:
        return state, False
    if kind == LETTER:
        if state == ONE_LEFT:
            return FRESH, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind], True
    if kind == INNER:
        return IN_WHITE, state != IN_WHITE
    return (JOINING if kind == SPACE else FRESH), True


def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class; products of functions; what each function makes of each state; token starts."""
    n = 2 * ROW
    starts = np.zeros((8, n), bool)
    generators = []
    for kind in range(n):
        row, base = divmod(kind, ROW)
        moves = [_step(FRESH if row else s, base) for s in range(8)]
        generators.append(tuple(m[0] for m in moves))
        starts[:, kind] = [bool(row) or m[1] for m in moves]
    known = {tuple(range(8)): 0}
    queue = [*known]
    for f in queue:
        for g in generators:
            product = tuple(g[s] for s in f)
            if product not in known:
                known[product] = len(known)
                queue.append(product)
    functions = list(known)
    images = np.array(functions, np.uint8)
    products = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return np.array([known[g] for g in generators], np.uint16), products, images, starts


OF_CLASS, PRODUCTS, IMAGES, STARTS = _machine()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, or white space (INNER)."""
    if not _CLASSES:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def token_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices at which pre-tokens start. points: code points of all rows; rows: where non-empty rows begin."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 2, bool)
    first[rows] = True
    first[n:] = True
    white = kind == INNER
    more = np.zeros(n, bool)  # the next character is in the same row and no white space
    more[:-1] = ~white[1:] & ~first[1:n]
    kind[white & more & (points == 0x20)] = SPACE
    kind[white & more & (points != 0x20)] = GAP
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = wide[marks + 1], wide[marks + 2]
        near, far = ~first[marks + 1], ~first[marks + 1] & ~first[np.minimum(marks + 2, n + 1)]
        kind[marks[near & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        kind[marks[far & pairs]] = LONG
    kind[rows] += ROW
    height = -(-n // BLOCK)
    grid = np.full(height * BLOCK, SAME, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(height, BLOCK).T)
    whole = np.zeros(height, np.uint16)
    for column in grid:
        whole = PRODUCTS[whole, OF_CLASS[column]]
    shift = 1
    while shift < height:  # inclusive scan of the blocks' products
        whole[shift:] = PRODUCTS[whole[:-shift], whole[shift:]]
        shift *= 2
    state = np.zeros(height, np.uint8)
    state[1:] = IMAGES[whole[:-1], FRESH]
    found = np.empty((BLOCK, height), bool)
    step = np.ascontiguousarray(IMAGES[OF_CLASS].T)  # state, class -> state
    for i, column in enumerate(grid):
        found[i] = STARTS[state, column]
        state = step[state, column]
    return np.flatnonzero(found.T.reshape(-1)[:n])


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((buf & 0xC0) != 0x80)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of the lowest rank is merged, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) >= HEAP_FROM:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 62
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or right[i] != j or end[j] != stop:
            continue  # one side has been merged since
        end[i], right[i] = stop, right[j]
        end[j] = -1
        if right[j] >= 0:
            left[right[j]] = i
            if (r := ranks.get(piece[i : end[right[j]]])) is not None:
                heapq.heappush(heap, (r, i, right[j], end[right[j]]))
        if (k := left[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, i, stop))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class PairMerger:
    """Merges many short slices side by side: each round merges the best pair of every slice."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(ids), _NONE)  # of the pair that begins here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.rank(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(rank, first)
            ended = low == _NONE
            if ended.any():
                for i, a, n in zip(owner[first[ended]].tolist(), first[ended].tolist(), sizes[ended].tolist()):
                    out[i] = ids[a : a + n].tolist()
                live = np.repeat(~ended, sizes)
                ids, owner, rank, low, sizes = ids[live], owner[live], rank[live], low[~ended], sizes[~ended]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            ids[hit] = rank[hit]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))  # where they are once the right halves are gone
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            for at in (hit, hit[hit > 0] - 1):
                rank[at] = _NONE
                at = at[at + 1 < len(ids)]
                at = at[owner[at] == owner[at + 1]]
                rank[at] = self.rank(ids[at], ids[at + 1])
        return out


_NONE = 1 << 62


class Codec:
    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes[i] = token
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.cache: dict[bytes, list[int]] = {}
        self.merger = PairMerger(self.ranks)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows; the byte of its row at which each token begins; where each row's ids begin."""
        rows = len(offsets) - 1
        if not len(buf):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(rows + 1, np.int64)
        points, at = code_points(buf)
        starts = at[token_starts(points, np.searchsorted(at, np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])))]
        ends = np.append(starts[1:], len(buf))
        first, where = distinct_spans(buf, starts, ends)
        raw, cache = buf.tobytes(), self.cache
        if len(cache) > REMEMBERED:
            cache.clear()
        found, new, short = [], [], []
        for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist())):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                if (whole := self.ranks.get(piece)) is not None:
                    ids = [whole]
                elif b - a >= HEAP_FROM:
                    ids = merge(piece, self.ranks)
                else:
                    new.append(i)
                    short.append(piece)
                if ids is not None and b - a <= LONGEST_REMEMBERED:
                    cache[piece] = ids
            found.append(ids)
        for i, piece, ids in zip(new, short, self.merger.merge(short) if short else ()):
            found[i] = cache[piece] = ids
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int32)
        begin = np.cumsum(sizes) - sizes
        counts = sizes[where]
        ids = flat[np.repeat(begin[where], counts) + ranges(counts)]
        lengths = self.lengths[ids]
        tokens = np.cumsum(lengths) - lengths
        bounds = np.searchsorted(tokens, offsets)
        return ids, tokens - np.repeat(offsets[:-1], np.diff(bounds)), bounds

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: What encode() can add.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "offsets": T.ArrayType(T.LongType()),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def _digests(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    names = [str(i) for i in range(int(ids.max()) + 1)] if len(ids) else []
    return [hashlib.sha256(" ".join(map(names.__getitem__, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(bounds, bounds[1:])]


def encode(docs: DataFrame, vocabulary: str, outputs=("n_tokens", "ids", "offsets"), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the chosen OUTPUTS. vocabulary: path of a rank file on every
    executor. ids_sha256 digests the decimal ids; decoded_sha256 what the ids decode to."""
    arrow_limits(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    columns = list(dict.fromkeys([*kept, text]))
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    at = columns.index(text)
    outputs = list(outputs)

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, text):
                ids, tokens, bounds = own.encode(*text_buffer(part.column(at)))
                made = {
                    "n_tokens": lambda: pa.array(np.diff(bounds), pa.int64()),
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    "offsets": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens, pa.int64())),
                    "ids_sha256": lambda: pa.array(_digests(ids, bounds), pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(own.decode(ids[a:b].tolist())).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(c)) for c in kept), *(made[o]() for o in outputs)], names=[*kept, *outputs])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """encoded with the column ``into``: the text of its ids; bytes that are not UTF-8 become U+FFFD."""
    arrow_limits(encoded.sparkSession)
    encoded = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c != into))
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            lists = batch.column(names.index(ids)).to_pylist()
            texts = [own.decode(x or []).decode(errors="replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return encoded.mapInArrow(run, schema)
