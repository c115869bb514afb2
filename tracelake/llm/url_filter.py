"""URL filters: host and path rules, and for URLs that no rule fits a ratio of two character models.

Accepted and rejected URLs each get a variable-order Markov model over bytes, smoothed by
Witten-Bell interpolation from order ORDER down to a uniform 1/256. The score of a URL is the
difference of the two log-likelihoods divided by its length. The threshold is that with the best mean
of both classes' accuracies over all labelled URLs, each scored by models that have learned all others.

The labelled URLs are those that a rule decides. The models count every distinct one, whole; copies of a
URL count once, in the models and in the threshold. The counts may be larger than a worker's memory, so
they are not broadcast: distinct URLs are dealt into slices, a slice sends each hash partition of contexts
a sorted list of its pairs of context and byte and their counts in either class, the partition adds up all
lists and answers each with the totals of its pairs, and the slice scores its URLs with them. Pairs are
told apart exactly. A pair costs one entry a slice, so none is hot; slices and partitions grow in number
with the distinct URLs, not in size, but for a URL longer than a slice. Scores are joined back to the rows
by URL, those of very frequent URLs by broadcast.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule. An empty text has a
score of 0. Where a class has no labelled URL there is no model; then every undecided URL is allowed.
Repeated rows get equal results; extra columns stay, except those named like the results. An empty table
gives no rows. URLs of any length are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm._shared import arrow_limits, cut, mix, release, unused
from tracelake.llm.lm_scoring import _freed, _groups, pack, unpack

ORDER = 5
#: Bytes of distinct URLs for a slice, for a slice of a small table, and for each hash partition.
SLICE_BYTES = 512 << 10
LEAST_BYTES = 256 << 10
PARTITION_BYTES = 1 << 20
#: Steps of the threshold's search in a unit of the score.
BINS = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host followed by the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def parts(url: Column) -> tuple[Column, Column, Column]:
    """What follows the scheme, the host in lower case, and the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return rest, host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _lay_out(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` start marks; the positions of bytes; their rows."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(2)
    row = np.repeat(np.arange(len(texts)), lengths)
    scored = np.arange(len(joined)) + (row + 1) * order
    symbols = np.ones(len(joined) + order * len(texts), np.uint64)
    symbols[scored] = joined
    return symbols, scored, row


class Slice:
    """Distinct URLs, the class of each (1 accepted, 2 rejected, 0 neither), and their pairs of context and byte."""

    def __init__(self, texts: list[bytes], classes: list[int]):
        symbols, self.scored, self.row = _lay_out(texts, ORDER)
        self.length, self.classes = np.array([len(t) for t in texts]), np.array(classes)
        self.distinct = []
        for k in range(ORDER + 1):  # the order, then symbols of nine bits: 64 bits hold those up to order 5
            pair = np.full(len(self.scored), k, np.uint64)
            for j in range(k, -1, -1):
                pair = pair << np.uint64(9) | symbols[self.scored - j]
            self.distinct.append(np.unique(pair, return_inverse=True))
        self.keys = np.concatenate([keys for keys, _ in self.distinct])

    def deal(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the pairs by partition, and where the partitions begin and end in it."""
        parts = mix(self.keys >> np.uint64(9)) >> np.uint64(64 - bits) if bits else np.zeros(len(self.keys), np.uint64)
        order = np.argsort(parts, kind="stable")
        return order, np.searchsorted(parts[order], np.arange((1 << bits) + 1, dtype=np.uint64))

    def counts(self) -> np.ndarray:
        """Of each pair in either class."""
        of = self.classes[self.row]
        return np.array([np.concatenate([np.bincount(where, of == c, len(keys)) for keys, where in self.distinct]) for c in (1, 2)]).astype("<u4")

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each URL, by the models of all labelled ones, and by those without itself; NaN without a class.
        totals: for either class the count of each pair, of its context, and of kinds of bytes after that."""
        p = [np.full(len(self.scored), 1 / 256) for _ in (1, 2)]
        mine = np.flatnonzero(self.classes[self.row])
        own, alone, at = self.classes[self.row[mine]] - 1, np.full(len(mine), 1 / 256), 0
        for keys, where in self.distinct:
            part, at = totals[:, :, at : at + len(keys)], at + len(keys)
            p = [_interpolate(p[c], *part[c][:, where]) for c in (0, 1)]
            if len(mine):
                n, total, kinds = part[own, :, where[mine]].T
                less = _own(self.row[mine], where[mine], n, keys >> np.uint64(9))
                alone = _interpolate(alone, n - less[0], total - less[1], kinds - less[2])
        rows = len(self.length)
        accepted, rejected = (np.bincount(self.row, np.log(x), rows) for x in p)
        without = np.bincount(self.row[mine], np.log(alone), rows)
        left_out = np.where(self.classes == 1, without - rejected, accepted - without)
        return (accepted - rejected) / self.length, np.where(self.classes > 0, left_out / self.length, np.nan)


def _interpolate(p: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)


def _own(row: np.ndarray, pair: np.ndarray, n: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the URL of each position adds itself to the counts of its pair and of its context, and to the kinds
    of bytes after that. pair: numbers of pairs, whose sorted contexts are ``contexts``; n: their counts."""
    code, first, at, own = np.unique(row * len(contexts) + pair, return_index=True, return_inverse=True, return_counts=True)
    of, context = code // len(contexts), contexts[code % len(contexts)]
    new = np.ones(len(code), bool)
    new[1:] = (of[1:] != of[:-1]) | (context[1:] != context[:-1])
    group = np.cumsum(new) - 1
    total, kinds = np.bincount(group, own), np.bincount(group, n[first] == own)
    return own[at], total[group][at].astype(np.int64), kinds[group][at].astype(np.int64)


def _totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For either class the counts of each key, of its context, and of kinds of bytes after that, over all keys."""
    known, where = np.unique(keys, return_inverse=True)
    context = known >> np.uint64(9)
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    width = np.diff(np.append(starts, len(known)))
    out = []
    for c in counts:
        n = np.bincount(where, c, len(known)).astype("<i8")
        total, kinds = np.add.reduceat(n, starts), np.add.reduceat((n > 0).astype("<i8"), starts)
        out.append(np.array([n, np.repeat(total, width), np.repeat(kinds, width)])[:, where])
    return np.array(out)


def score_distinct(urls: DataFrame, size: int) -> DataFrame:
    """urls: raw (distinct, not empty), class and n; with score and left_out (by the models without the URL
    itself) of each. size: the bytes of all."""
    spark = urls.sparkSession
    arrow_limits(spark)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-size // SLICE_BYTES), min(cores, size // LEAST_BYTES))
    bits = (size // PARTITION_BYTES).bit_length()
    dealt = urls.withColumn("slice", F.pmod(F.xxhash64("raw"), F.lit(slices)).cast("int"))

    def send(batches):
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for number, rows in _groups(batches, 0, 3):
            part = Slice([r[1] for r in rows], [r[2] for r in rows])
            order, edges = part.deal(bits)
            keys, counts = part.keys[order], part.counts()[:, order]
            out = [(p, number, zstandard.compress(pack(keys[a:b]), 1), zstandard.compress(counts[:, a:b].tobytes(), 1)) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["p", "slice", "keys", "counts"])
            release()

    def add(batches):
        types = [pa.int32(), pa.int32(), pa.binary()]
        for p, rows in _groups(batches, 0, 4):
            keys = [unpack(zstandard.decompress(r[2])) for r in rows]
            counts = [np.frombuffer(zstandard.decompress(r[3]), "<u4").reshape(2, -1) for r in rows]
            totals = _totals(np.concatenate(keys), np.concatenate(counts, axis=1))
            ends = np.cumsum([len(k) for k in keys])
            for r, k, end in zip(rows, keys, ends):
                answer = zstandard.compress(totals[:, :, end - len(k) : end].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((p, r[1], answer), types)], names=["p", "slice", "totals"])
            release()

    lists = dealt.select("slice", "raw", "class").repartition("slice").sortWithinPartitions("slice", "raw").mapInArrow(send, "p int, slice int, keys binary, counts binary")
    with _freed(spark):
        answers = cut(lists.repartition("p").sortWithinPartitions("p", "slice").mapInArrow(add, "p int, slice int, totals binary"), "url-totals")
    columns = ["slice", "p", "totals", "raw", "class", "n"]
    answers = answers.select("slice", "p", "totals", F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("int").alias("class"), F.lit(None).cast("long").alias("n"), F.lit(0).alias("side"))
    own = dealt.withColumns({"p": F.lit(None).cast("int"), "totals": F.lit(None).cast("binary")}).select(*columns, F.lit(1).alias("side"))

    def finish(batches):
        types = [pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        for _, rows in _groups(batches, 0, 7):
            urls = [r for r in rows if r[6] == 1]
            part = Slice([r[3] for r in urls], [r[4] for r in urls])
            totals = np.empty((2, 3, len(part.keys)), "<i8")
            totals[:, :, part.deal(bits)[0]] = np.concatenate([np.frombuffer(zstandard.decompress(r[2]), "<i8").reshape(2, 3, -1) for r in rows if r[6] == 0], axis=2)
            score, left_out = part.scores(totals)
            out = [[r[3] for r in urls], [r[4] for r in urls], [r[5] for r in urls], score, left_out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["raw", "class", "n", "score", "left_out"])
            release()

    both = answers.union(own).repartition("slice").sortWithinPartitions("slice", "side", "p", "raw")
    with _freed(spark):
        return cut(both.mapInArrow(finish, "raw binary, class int, n long, score double, left_out double"), "url-scores")


def best_threshold(scored: DataFrame, good: int, bad: int) -> float:
    """What calibrate gives for left_out of the classes 1 (``good`` rows) and 2 (``bad`` rows), without a sort in
    one task: sums by bins of the score come first, then those within each bin."""
    of = [F.count(F.when(F.col("class") == c, 1)).alias(name) for c, name in ((1, "g"), (2, "b"))]
    points = scored.filter("class > 0").groupBy("left_out").agg(*of).withColumn("bin", F.floor(F.col("left_out") * BINS))
    by_bin = Window.orderBy("bin")
    below = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    bins = points.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("left_out").alias("top"))
    bins = bins.select("bin", F.sum("g").over(below).alias("g0"), F.sum("b").over(below).alias("b0"), F.lag("top").over(by_bin).alias("top0"))
    inside = Window.partitionBy("bin").orderBy("left_out")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # cut before each score: everything from it on is accepted
    dropped = {c: F.coalesce(f"{c}0", F.lit(0)) + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in "gb"}
    score = F.col("left_out")
    cuts = points.join(F.broadcast(bins), "bin").select(
        score, ((score + F.coalesce(F.lag(score).over(inside), "top0", score - 2)) / 2).alias("edge"),
        ((F.lit(good) - dropped["g"]) / F.lit(good) + dropped["b"] / F.lit(bad)).alias("balanced"),
    )
    most, last = cuts.agg(F.max("balanced"), F.max("left_out")).first()
    least, greatest = cuts.filter(F.col("balanced") >= F.lit(most - 1e-12)).agg(F.min("edge"), F.max("edge")).first()
    # the cut behind the last score accepts nothing, which is as good as to accept everything
    return (least + (last + 1 if most <= 1 + 1e-12 else greatest)) / 2


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, verdict and score (log-likelihood difference a byte); columns of these
    names are replaced."""
    raw, given, salt, hot_score, own_score = unused(pages.columns, "__raw", "__said", "__salt", "__hot", "__score")
    rest, host, path = parts(F.col(url))
    split = pages.withColumns({raw: rest.cast("binary"), "host": host, "path": path})
    name, said = rule_columns(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": name, given: said})
    number = F.when(F.col(given) == "allow", 1).when(F.col(given) == "block", 2).otherwise(0)
    urls = split.filter(F.octet_length(raw) > 0).groupBy(F.col(raw).alias("raw")).agg(F.max(number).alias("class"), F.count("*").alias("n"))
    urls = cut(urls, "urls")
    of = [F.count(F.when(F.col("class") == c, 1)) for c in (1, 2)]
    size, rows, good, bad = urls.agg(F.sum(F.octet_length("raw")), F.sum("n"), *of).first()
    if not good or not bad:
        scored, threshold = split.withColumn("score", F.lit(0.0)), 0.0
    else:
        scores = score_distinct(urls, size)
        threshold = best_threshold(scores, good, bad)
        # URLs with a share of the rows, so not many, are not dealt by URL; their rows and those without one fit no key
        hot = F.col("n") > max(1000, rows // 10_000)
        few = scores.filter(hot).select(F.col("raw").alias(raw), F.col("score").alias(hot_score))
        others = scores.filter(~hot).select(F.col("raw").alias(raw), F.lit(-1).cast("long").alias(salt), F.col("score").alias(own_score))
        scored = split.join(F.broadcast(few), raw, "left")
        apart = F.col(hot_score).isNotNull() | (F.octet_length(raw) == 0)
        scored = scored.withColumn(salt, F.when(apart, F.monotonically_increasing_id()).otherwise(-1)).join(others, [raw, salt], "left")
        scored = scored.withColumn("score", F.coalesce(hot_score, own_score, F.lit(0.0)))
    by_model = F.when(F.col("score") >= F.lit(threshold), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce(given, by_model)).drop(raw, given, salt, hot_score, own_score)
