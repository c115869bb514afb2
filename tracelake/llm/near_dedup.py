"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set holds its distinct shingles of ``shingle`` words (2 unless given), words lower-cased in
A-Z; a document with fewer words is one shingle. Two documents are linked if 100 * intersection >= 80 * union; a component is what links reach.

Sketch: in round i < COORDINATES every shingle is thrown into one hashed bin, and a bin keeps the
least hash of the first round that reached it. Round COORDINATES + j throws all shingles into bin j.
So every coordinate is filled after 2 * COORDINATES rounds, two or three in practice. A coordinate of
two sketches agrees with the probability of the Jaccard similarity, with Chernoff-style concentration.
With 32 bands of 4 coordinates a pair at 0.8 shares no band with a probability of 5e-8.

1. Equal sets are one class, named by its least doc_id; only classes are compared.
2. The members of a bucket (band, value) form a group with the bucket's least class as centre.
3. Groups of up to GROUP classes are resolved in one task: every pair that is not yet connected is
   checked on full sets. Larger groups are salted: each part checks its members against the centre.
4. Links become components by least-label propagation with pointer jumping.
5. In a large group, a member that is not in its centre's component can still have a link to another
   member. Groups whose centres share a component become one, around the least class of it. Each
   member is known by its difference from that centre: extra and missing shingles. A link needs so
   many common extra shingles that, in the order of their hashes, prefixes of both must meet. That
   join, for members of different components, gives the candidates; its condition also has the bound
   from the shingles' places and one from parity bitmaps of the differences, whose Hamming distance
   never exceeds that of the sets. The differences give the exact intersections.

No step holds all pairs of a group, and no link between different sets that share a bucket is left out.

Null text and text without words have an empty set and no link. A null doc_id has no link and a null
component; such rows are kept. Rows that repeat a doc_id are each returned. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tracelake.llm._shared import SPACE, arrow_limits, as_long, cut, hash_spans, mix, release, slices, split_words, text_buffer

COORDINATES, BANDS = 128, 32
#: Classes of a group, or of a part of one, that one task holds.
GROUP = 64
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Words of a shingle.
SHINGLE = 2
#: Bytes of text of whole groups that are verified together.
VERIFY_BYTES = 4 << 20
#: Longs of a parity bitmap.
SIGN = 4

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NONE = np.uint64(2**64 - 1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each row."""
    starts, ends, row = split_words(buf, offsets, SPACE)
    words = hash_spans(buf, starts, ends, lower=True)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    # runs[k]: hashes of k + 1 words; those of fewer than a shingle are only for rows without more.
    runs = [words]
    for k in range(1, shingle):
        runs.append(mix(runs[-1][:-1] * np.uint64(0xD6E8FEB86659FD93) + words[k:]) if len(words) > k else words[:0])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        out.append(np.unique(runs[-1][a : b - shingle + 1]) if n >= shingle else mix(runs[n - 1][a : a + 1] + np.uint64(0x2545F4914F6CDD1D)) if n else words[:0])
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values for each set; an empty set has a row of the largest value."""
    rows = len(sets)
    out = np.full(rows * COORDINATES, _NONE)
    items = np.concatenate(sets) if rows else np.empty(0, np.uint64)
    row = np.repeat(np.arange(rows), [len(s) for s in sets])
    for i, seed in enumerate(_SEEDS):
        if not len(items):
            break
        value = np.minimum(mix(items ^ seed), _NONE - np.uint64(1))
        column = (value >> np.uint64(57)).astype(np.int64) if i < COORDINATES else i - COORDINATES
        bins = row * COORDINATES + column
        free = out[bins] == _NONE  # no earlier round has reached the bin
        least = np.full(len(out), _NONE) if i < 4 else None
        if least is not None:
            np.minimum.at(least, bins[free], value[free])
            np.minimum(out, least, out=out)
        else:
            np.minimum.at(out, bins[free], value[free])
        open_rows = (out.reshape(rows, COORDINATES) == _NONE).any(axis=1)
        live = open_rows[row]
        items, row = items[live], row[live]
    return out.reshape(rows, COORDINATES)


def bands(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys a row; each hashes one band's number and coordinates."""
    parts = sketch.reshape(len(sketch), BANDS, COORDINATES // BANDS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(a) + len(b) - common)


def parity(items: np.ndarray) -> list[int]:
    """SIGN longs; a bit is set if an odd number of items falls on it. Where two bitmaps differ, there is
    an item that only one of the sets has."""
    bits = np.bincount((items % np.uint64(64 * SIGN)).astype(np.int64), minlength=64 * SIGN).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def signatures(docs: DataFrame, text: str, doc: str, shingle: int = SHINGLE) -> DataFrame:
    """doc, n (set size), k1 and k2 (128 bits that name the set), bands."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                sets = shingle_sets(*text_buffer(part.column(1)), shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                k1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
                k2 = np.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(s) else 0 for s in sets], np.uint64)
                keys = as_long(np.ascontiguousarray(bands(sketches(sets)))).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(as_long(k1)), pa.array(as_long(k2)), lists], names=["doc", "n", "k1", "k2", "bands"])

    return docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, "doc long, n long, k1 long, k2 long, bands array<long>")


OUT = "kind int, c long, x long, n long, nc long, linked boolean, extra array<long>, missing array<long>, sign array<long>"


def _resolve(members: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect a small group: every pair not yet connected is checked."""
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(members)):
        for j in range(i + 1, len(members)):
            a, b = find(i), find(j)
            if a != b and linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((members[i], members[j]))
    return out


def verify(groups: DataFrame, docs: DataFrame, group: int = GROUP, percent: int = PERCENT, differences: bool = False, shingle: int = SHINGLE) -> DataFrame:
    """groups: c, x, size (members besides the centre). Links (kind 0: c, x) that connect small groups, and
    those of the members of large ones to the centre; or the members' differences from it (kind 1)."""
    parts = F.ceil(F.col("size") / group).cast("int")
    members = groups.select("c", "size", F.col("x").alias("node"), F.when(F.col("size") > group, F.pmod(F.xxhash64("x"), parts)).otherwise(0).cast("int").alias("part"), F.lit(False).alias("centre"))
    centres = groups.groupBy("c").agg(F.max("size").alias("size")).select("c", "size", F.col("c").alias("node"), F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"), F.lit(True).alias("centre"))
    # A merge join at every size: a broadcast where few members are left would not do on a larger corpus.
    texts = members.unionByName(centres).hint("merge").join(docs, F.col("node") == F.col("doc")).select("c", "part", "size", "centre", "node", "text")
    spread = texts.repartition("c", "part").sortWithinPartitions("c", "part", F.desc("centre"), "node")

    def settle(rows: list[tuple], texts: list[bytes]):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sets = shingle_sets(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), shingle)
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][:2] == rows[i][:2]:
                j += 1
            c, size = rows[i][0], rows[i][2]
            if size <= group and not differences:
                yield from ((0, a, b, 0, 0, True, None, None, None) for a, b in _resolve([r[4] for r in rows[i:j]], sets[i:j], percent) if a != b)
            elif rows[i][3]:
                for k in range(i + 1, j):
                    if rows[k][3] or rows[k][4] == c:
                        continue
                    link = linked(sets[i], sets[k], percent)
                    if not differences:
                        if link:
                            yield 0, c, rows[k][4], 0, 0, True, None, None, None
                        continue
                    extra, missing = (np.setdiff1d(*pair, assume_unique=True) for pair in ((sets[k], sets[i]), (sets[i], sets[k])))
                    sign = parity(np.concatenate([extra, missing]))
                    yield 1, c, rows[k][4], len(sets[k]), len(sets[i]), link, as_long(extra).tolist(), as_long(missing).tolist(), sign
            i = j

    def run(batches):
        rows, texts, size = [], [], 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3]
        names = ["kind", "c", "x", "n", "nc", "linked", "extra", "missing", "sign"]

        def flush():
            found = list(settle(rows, texts))
            return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*found) if found else [[]] * 9, types)], names=names)

        for batch in batches:
            raw, offsets = text_buffer(batch.column(5))
            body = raw.tobytes()
            for r, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                if size > VERIFY_BYTES and rows[-1][:2] != row[:2]:
                    yield flush()
                    rows, texts, size = [], [], 0
                    release()
                rows.append(row)
                texts.append(body[offsets[r] : offsets[r + 1]])
                size += len(texts[-1])
        if rows:
            yield flush()
        release()

    return spread.mapInArrow(run, OUT)


def inner_links(diffs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of large groups that are in different components. diffs: with component."""
    p = percent
    linked_ = F.col("component") == F.col("c")
    diffs = diffs.withColumn("linked", linked_)
    own = F.col("n") - F.size("extra")  # shared with the centre
    lows = diffs.groupBy("c").agg(F.min("n").alias("low"))
    # A link of sizes n, m needs (100 + p) * common >= p * (n + m); m is at least ...
    least = F.greatest(F.col("low"), F.ceil(p * F.col("n") / 100))
    need = F.ceil(p * (F.col("n") + least) / (100 + p)) - own
    known = diffs.join(lows, "c").select("c", "x", "n", "linked", "component", own.alias("own"), F.size("extra").alias("k"), need.alias("need"), "extra", "sign")
    # Extra shingles are sorted by hash, the same order for all members.
    front = F.slice("extra", 1, F.greatest(F.col("k") - F.greatest("need", F.lit(1)) + 1, F.lit(0)).cast("int"))
    prefix = cut(known.select("*", F.posexplode(front).alias("place", "t")).drop("extra"), "prefixes")
    mine = ["n", "linked", "own", "component", "sign"]

    def side(df: DataFrame, mark: str, *keys: str, more: tuple = ()) -> DataFrame:
        return df.select("c", *keys, F.col("x").alias("x" + mark), *(F.col(m).alias(m + mark) for m in (*mine, *more)))

    both_n, shared = F.col("n1") + F.col("n2"), F.least("own1", "own2")
    once = (F.col("component1") != F.col("component2")) & (F.col("linked2") | (F.col("x1") < F.col("x2")))
    sizes = (100 * F.col("n1") >= p * F.col("n2")) & (100 * F.col("n2") >= p * F.col("n1"))
    # At most n + m - 2 * common shingles are in one set only.
    apart = reduce(add, (F.bit_count(F.col("sign1")[i].bitwiseXOR(F.col("sign2")[i])) for i in range(SIGN)))
    alike = (100 + p) * (both_n - apart) >= 2 * p * both_n
    # If this is the first common extra shingle, only those after it can be common too.
    after = F.least(F.col("k1") - F.col("place1"), F.col("k2") - F.col("place2"))
    reach = (100 + p) * (shared + after) >= p * both_n
    front1, front2 = (side(df, m, "t", more=("k", "place")) for m, df in (("1", prefix.filter("not linked")), ("2", prefix)))
    meet = front1.join(front2, ["c", "t"]).filter(once & sizes & reach & alike)
    # Members so close to the threshold that a smaller one may be linked without a common extra shingle.
    enough = (100 + p) * shared >= p * both_n
    close = side(known.filter("not linked and need <= 0"), "1").join(side(known, "2"), "c").filter(once & sizes & enough & alike)
    pairs = meet.select("c", "x1", "x2").union(close.select("c", "x1", "x2")).distinct()
    sets = [diffs.select("c", F.col("x").alias("x" + m), F.col("n").alias("n" + m), F.col("nc").alias("nc" + m), F.col("extra").alias("extra" + m), F.col("missing").alias("missing" + m)) for m in "12"]
    both = pairs.join(sets[0], ["c", "x1"]).join(sets[1], ["c", "x2"])
    common = (
        F.col("nc1") - F.size("missing1") - F.size("missing2") + F.size(F.array_intersect("missing1", "missing2")) + F.size(F.array_intersect("extra1", "extra2"))
    )
    return both.filter(100 * common >= p * (F.col("n1") + F.col("n2") - common)).select(F.col("x1").alias("a"), F.col("x2").alias("b"))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, label (the least node that it reaches) for the nodes of edges (a, b); ``most``: twice the edges, if known."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", most)
    rows = both.count()
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels", rows)
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        low = heard.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        to = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = low.join(to, "label", "left").select("node", F.least("label", "further").alias("label"))
        new = cut(jumped, "labels", rows)
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").filter("label != old").limit(1).count()
        labels = new
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", group: int = GROUP, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    arrow_limits(docs.sparkSession)
    signed = cut(signatures(docs, text, doc, shingle), "signatures")
    full = signed.filter("doc is not null and n > 0")
    classes = cut(full.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands")), "classes")
    distinct = classes.count()
    members = classes.select(F.col("rep").alias("x"), F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("x").alias("c"), F.count("*").alias("k")).filter("k > 1").drop("k")
    pairs = cut(members.join(buckets, "key").filter("x != c").select("c", "x").distinct(), "pairs", BANDS * distinct)
    groups = pairs.join(pairs.groupBy("c").agg(F.count("*").alias("size")), "c")
    texts = docs.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    n = pairs.count()
    groups = cut(groups, "groups", n)
    links = cut(verify(groups, texts, group, percent, shingle=shingle).select(F.col("c").alias("a"), F.col("x").alias("b")), "links")
    labels = components(links, 2 * links.count())
    large = groups.filter(F.col("size") > group).select("c", "x")
    for end in ("c", "x"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias("l" + end))
        large = large.join(of, end, "left").withColumn("l" + end, F.coalesce("l" + end, end))
    # A centre has been checked against all its members, so a group whose members are in one component is done.
    several = large.groupBy("c").agg(F.min("lx").alias("lo"), F.max("lx").alias("hi")).filter("lo != hi").select("c")
    large = large.join(several, "c")
    merged = cut(large.select(F.col("lc").alias("c"), "x", F.col("lx").alias("component")).filter("c != x").distinct(), "merged", n)
    sizes = merged.groupBy("c").agg(F.count("*").alias("size"), F.count_if(F.col("component") != F.col("c")).alias("apart")).filter("apart > 0")
    if sizes.limit(1).count():
        around = merged.join(sizes.drop("apart"), "c")
        differences = verify(around.drop("component"), texts, group, percent, differences=True, shingle=shingle).join(merged, ["c", "x"])
        inner = inner_links(cut(differences.drop("kind", "linked"), "differences"), percent)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(inner))
    named = signed.join(classes.drop("bands"), ["n", "k1", "k2"], "left").join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "rep", "doc"))
    out = named.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """One document of each component, that with the least id; rows with a null id stay."""
    verdicts = near_duplicates(docs, text, doc, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return docs.join(verdicts, F.col(f"`{doc}`").cast("long") == F.col("__dropped"), "left_anti")
