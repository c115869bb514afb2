"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the model says (identity: a space before it, spaces become the space symbol) and its
characters are the first symbols. An agenda holds the adjacent pairs that together are a piece, highest score
first, then the leftmost; what it gives is merged, and pairs with the new symbol's neighbours join the agenda.
Pairs one side of which has been merged since are passed over. Characters without a piece become byte pieces.

No symbol can grow across two characters that no piece holds side by side. So a batch is cut at all such
places, found with one table look-up a character, and distinct slices, told apart by their bytes, go through an
agenda once and are remembered. The result is that of one agenda over the whole text.

``disagreements`` holds the codec against the sentencepiece library, in Arrow batches.

Null text counts as empty: no ids, decoded as the empty text. Rows are independent, so repeated rows and ties
give equal results; extra columns stay, except those named like the results. An empty table gives no rows. Texts
are encoded whole, however long; a slice of n characters takes O(n log n). Models of another type, with another
normaliser, without byte pieces, or with user-defined or unused pieces raise ValueError.
"""

from __future__ import annotations

import contextlib
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm._shared import arrow_limits, distinct_spans, ranges, slices, text_buffer
from tracelake.llm.bpe import code_points

# Fixed values of the model format.
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6
SPACE = "▁"
#: Distinct slices that a task remembers, and the bytes of one, at most.
REMEMBERED, LONGEST_REMEMBERED = 1 << 19, 256


class Model:
    """What a model file says. Inside, the space symbol is a plain space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        told = proto.ModelProto()
        with open(path, "rb") as f:
            told.ParseFromString(f.read())
        norm, kinds = told.normalizer_spec, {p.type for p in told.pieces}
        if told.trainer_spec.model_type != BPE or not told.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only merge-type models with byte pieces and without user-defined or unused ones")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or told.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only the identity normaliser")
        self.prefix = norm.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids, self.texts, self.kinds = [0] * 256, [], []
        for i, p in enumerate(told.pieces):
            text = p.piece.replace(SPACE, " ")
            self.kinds.append(p.type)
            if p.type == NORMAL:
                self.ids[text], self.scores[text] = i, p.score
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.texts.append({NORMAL: text.encode(), UNKNOWN: told.trainer_spec.unk_surface.encode(), CONTROL: b"", BYTE: bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""}[p.type])


def merge(text: str, model: Model) -> list[int]:
    """Ids of a slice of normalised text."""
    n, scores = len(text), model.scores
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := scores.get(text[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        _, i, j, stop = heappop(agenda)
        if end[i] != j or right[i] != j or end[j] != stop:
            continue  # one side has been merged since
        end[i], right[i], end[j] = stop, right[j], -1
        if (k := right[j]) >= 0:
            left[k] = i
            if (s := scores.get(text[i : end[k]])) is not None:
                heappush(agenda, (-s, i, k, end[k]))
        if (k := left[i]) >= 0 and (s := scores.get(text[k:stop])) is not None:
            heappush(agenda, (-s, k, i, stop))
    out, i = [], 0
    while 0 <= i < n:
        symbol = text[i : end[i]]
        if (found := model.ids.get(symbol)) is not None:
            out.append(found)
        else:
            out += map(model.byte_ids.__getitem__, symbol.encode())
        i = right[i]
    return out


class Codec:
    def __init__(self, path: str):
        self.model = Model(path)
        pairs = {(a, b) for piece in self.model.ids for a, b in zip(piece, piece[1:])}
        firsts, seconds = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
        # The place of a character among those that begin or end a pair; the last place is for all others.
        self.first, self.second = np.full(0x110000, len(firsts), np.uint16), np.full(0x110000, len(seconds), np.uint16)
        self.first[[ord(c) for c in firsts]] = np.arange(len(firsts))
        self.second[[ord(c) for c in seconds]] = np.arange(len(seconds))
        self.together = np.zeros((len(firsts) + 1, len(seconds) + 1), bool)
        for a, b in pairs:
            self.together[self.first[ord(a)], self.second[ord(b)]] = True
        # Characters of a token; those of a character in bytes are counted at its first byte.
        self.chars = np.array([len(t.decode()) if k != BYTE else int(t[0] & 0xC0 != 0x80) for t, k in zip(self.model.texts, self.model.kinds)], np.int64)
        self.controls = {i for i, k in enumerate(self.model.kinds) if k == CONTROL}
        self.names = [str(i) for i in range(len(self.model.texts))]
        self.cache: dict[bytes, list[int]] = {}

    def normalised(self, column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_string()).fill_null("")
        column = pc.replace_substring(column, SPACE, " ")
        if not self.model.prefix:
            return column
        return pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows; the character of its row at which each token begins; where each row's ids begin."""
        rows = len(column)
        buf, offsets = text_buffer(self.normalised(column))
        if not len(buf):
            return np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(rows + 1, np.int64)
        points, at = code_points(buf)
        apart = np.ones(len(points), bool)
        apart[1:] = ~self.together[self.first[points[:-1]], self.second[points[1:]]]
        apart[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
        starts = at[apart]
        ends = np.append(starts[1:], len(buf))
        first, where = distinct_spans(buf, starts, ends)
        raw, cache = buf.tobytes(), self.cache
        if len(cache) > REMEMBERED:
            cache.clear()
        found = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece.decode(), self.model)
                if b - a <= LONGEST_REMEMBERED:
                    cache[piece] = ids
            found.append(ids)
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int32)
        counts = sizes[where]
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[where], counts) + ranges(counts)]
        row = np.repeat(np.searchsorted(offsets, starts, side="right") - 1, counts)
        bounds = np.searchsorted(row, np.arange(rows + 1))
        chars = self.chars[ids]
        place = np.cumsum(chars) - chars
        place -= np.append(place, 0)[bounds[:-1]][row] if len(ids) else 0
        return ids, np.maximum(place - int(self.model.prefix), 0), bounds

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space that encoding puts before a text goes; of bytes that are no UTF-8 each
        becomes U+FFFD."""
        texts, kinds = self.model.texts, self.model.kinds
        head = next((i for i in ids if kinds[i] != CONTROL), None)
        whole = b"".join(map(texts.__getitem__, ids))
        cut = int(self.model.prefix and head is not None and kinds[head] == NORMAL and texts[head].startswith(b" "))
        if self.controls.isdisjoint(ids):  # they end a run of bytes
            with contextlib.suppress(UnicodeDecodeError):
                return whole[cut:].decode()
        parts, run = [], b""
        for i in [*ids, None]:
            if i is not None and kinds[i] == BYTE:
                run += texts[i]
                continue
            parts.append(_patched(run))
            parts.append(texts[i].decode() if i is not None else "")
            run = b""
        return "".join(parts)[cut:]


def _patched(run: bytes) -> str:
    out, i = [], 0
    while i < len(run):
        for n in range(1, 5):
            try:
                out.append(run[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


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
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, model: str, outputs=("n_tokens", "ids", "offsets"), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the chosen OUTPUTS. model: path of a model file on every executor.
    offsets are in characters of the text; ids_sha256 digests the decimal ids joined by commas, decoded_sha256
    what the ids decode to."""
    arrow_limits(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    columns = list(dict.fromkeys([*kept, text]))
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    at, outputs = columns.index(text), list(outputs)

    def run(batches):
        own = codec(model)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, text):
                ids, places, bounds = own.encode(part.column(at))
                listed = ids.tolist() if {"decoded", "ids_sha256", "decoded_sha256"} & {*outputs} else []
                edges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                decoded = [own.decode(listed[a:b]) for a, b in edges] if {"decoded", "decoded_sha256"} & {*outputs} else []
                made = {
                    "n_tokens": lambda: pa.array(np.diff(bounds), pa.int64()),
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    "offsets": lambda: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places, pa.int64())),
                    "decoded": lambda: pa.array(decoded, pa.string()),
                    "ids_sha256": lambda: pa.array([digest(",".join(map(own.names.__getitem__, listed[a:b]))) for a, b in edges], pa.string()),
                    "decoded_sha256": lambda: pa.array([digest(x) for x in decoded], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(columns.index(c)) for c in kept), *(made[o]() for o in outputs)], names=[*kept, *outputs])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """encoded with the column ``into``: the text of its ids, of null ids the empty text."""
    arrow_limits(encoded.sparkSession)
    encoded = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c != into))
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        own = codec(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return encoded.mapInArrow(run, schema)


def disagreements(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """The rows of docs whose ids or decoded text are not those of the sentencepiece library, with own_ids and
    library_ids. None, if all is right."""
    arrow_limits(docs.sparkSession)
    columns = docs.columns
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, OUTPUTS["ids"]) for c in ("own_ids", "library_ids"))])

    def run(batches):
        import sentencepiece

        own, library = codec(model), sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(columns.index(text)).fill_null("").to_pylist()
                ids, _, bounds = own.encode(part.column(columns.index(text)))
                mine = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
                theirs = library.encode(texts, num_threads=1)
                odd = [i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b or own.decode(a) != library.decode(b)]
                if odd:
                    lists = [pa.array([x[i] for i in odd], pa.list_(pa.int32())) for x in (mine, theirs)]
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(odd)).columns, *lists], names=[*columns, "own_ids", "library_ids"])

    return docs.mapInArrow(run, schema)
