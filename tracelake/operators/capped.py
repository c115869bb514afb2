"""A flow table of bounded size, with second-chance eviction, replayed only where it can be full.

A table without a bound holds every flow that the bounded one holds: the bounded one only forgets more. So a flow can be
evicted only while the unbounded table has as many flows as the bound, and how many it has is a running sum over births
and expiries of lives. The frames between are overload spans. Spans that a flow lives through both of hang together
and are one; what was evicted in a span is gone from both tables when the next one begins.

When a span begins, the table is known from lives alone: those that have begun and not expired, in order of birth, all
seen since. So spans are replayed side by side, each by one task over a few numbers a frame of the span, with the table
held; other tasks sort these numbers. All other frames are numbered by window functions, going on after a span with what the table held at its end. If the
unbounded table never has so many flows, nothing is replayed.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.flows import CHUNK, KEY, ended, instances
from tracelake.sources.ordered import in_order
from tracelake.sources.tables import cut

#: Spans that are told apart; those with the smallest gaps between them are replayed as one.
SPANS = 64
_NEVER = 1 << 62


def _lives(numbered: DataFrame, swept: DataFrame | None, timeout_us: int, *key: str) -> DataFrame:
    """Lives with start and end, the frame of the sweep that ends them or _NEVER, and expired_us."""
    seen = "watermark_us" if "watermark_us" in numbered.columns else "ts_us"
    start = F.coalesce("start", "frame_no") if "start" in numbered.columns else F.col("frame_no")
    found = numbered.groupBy(*key, "instance").agg(F.min(start).alias("start"), F.max("ts_us").alias("last_us"), F.max(seen).alias("seen_us"))
    if swept is None or not timeout_us:
        return found.withColumns({"expired_us": F.lit(None).cast("long"), "end": F.lit(_NEVER)})
    found = ended(cut(found, "lives"), swept, timeout_us)
    at = swept.select(F.col("sweep_us").alias("expired_us"), F.col("frame_no").alias("end"))
    return found.join(at, "expired_us", "left").withColumn("end", F.coalesce("end", F.lit(_NEVER)))


def overload(lives: DataFrame, most: int) -> list[tuple[int, int]]:
    """Spans (a, b): between the packets of frames a and b, b's sweep included, the unbounded table has at least ``most``
    flows at times; no life reaches from one span into another."""
    births = lives.select(F.col("start").alias("frame"), F.lit(0).alias("kind"), F.lit(1).alias("delta"), F.col("end").alias("until"))
    deaths = lives.filter(F.col("end") < _NEVER).groupBy(F.col("end").alias("frame")).agg(F.lit(1).alias("kind"), (-F.count("*")).alias("delta"), F.lit(-1).cast("long").alias("until"))
    events = births.unionByName(deaths).withColumn("chunk", F.floor(F.col("frame") / CHUNK))
    sums = events.groupBy("chunk").agg(F.sum("delta").alias("n"), F.max("until").alias("most"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    carry = sums.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.max("most").over(earlier), F.lit(-1)).alias("most"))
    inside = Window.partitionBy("chunk").orderBy("frame", "kind")
    run = events.withColumns({"own": F.sum("delta").over(inside), "reach": F.max("until").over(inside)}).join(carry, "chunk")
    after = F.col("own") + F.col("n")
    full, was = after >= most, after - F.col("delta") >= most
    flips = run.filter(full != was).select("frame", "kind", full.alias("on"), F.greatest("reach", "most").alias("reach"))
    # A row each time that the table fills or no longer is full, which takes a sweep.
    order = Window.orderBy("frame", "kind")
    flips = cut(flips.withColumns({"b": F.lag("frame").over(order), "dead": F.lag("reach").over(order)}), "flips")
    ends = flips.agg(F.min("frame"), F.max_by("on", F.struct("frame", "kind")), F.max("frame")).first()
    if ends[0] is None:
        return []
    gaps = flips.filter("on and b is not null and dead < frame").orderBy(F.desc(F.col("frame") - F.col("b")), "frame").limit(SPANS - 1)
    cuts = sorted((r.b, r.frame) for r in gaps.collect())
    starts, stops = [ends[0], *(a for _, a in cuts)], [*(b for b, _ in cuts), _NEVER if ends[1] else ends[2]]
    return list(zip(starts, stops))


def _span(frame: Column, spans: list[tuple[int, int]], first: bool) -> Column:
    """The number of spans that have begun before a frame, or at it if first."""
    return sum((F.when(frame >= a if first else frame > a, 1).otherwise(0) for a, _ in spans), F.lit(0))


def _within(region: Column, frame: Column, spans: list[tuple[int, int]]) -> Column:
    return (region > 0) & F.coalesce(frame <= F.get(F.array(*(F.lit(b) for _, b in spans)), region - 1), F.lit(False))


def _replay(rows: DataFrame, kinds: dict[str, str], most: int, timeout_us: int, spans: int) -> DataFrame:
    """rows by span: flows held at first, frames, sweeps. Gives frames with the start of their life, ends of lives, and what is
    held at the end (what = 0, 1, 2). A span's task reads rows that others have sorted; it holds the table and a batch."""
    schema = ", ".join(["span int, what int, frame_no long", *(f"{c} {t}" for c, t in kinds.items()), "start long, ts_us long, reason string"])

    def run(batches):
        span, table, clock, arrow = None, {}, deque(), None  # key -> [last time, seen since the clock passed, start]

        def out(found):
            parts = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, [pa.int32(), pa.int32(), pa.int64(), *arrow, pa.int64(), pa.int64(), pa.string()])], names=["span", "what", "frame_no", *kinds, "start", "ts_us", "reason"])

        def held():
            return [(span, 2, None, *key, e[2], e[0], None) for key, e in table.items()]

        for batch in batches:
            arrow = [batch.schema.field(5 + i).type for i in range(len(kinds))]
            found = []
            for own, phase, frame, kind, ts, *key, start in zip(*(c.to_pylist() for c in batch.columns)):
                if own != span:
                    found += held()
                    span, table, clock = own, {}, deque()
                if kind:  # a sweep
                    for old in [k for k, e in table.items() if ts - e[0] > timeout_us]:
                        found.append((span, 1, None, *old, table.pop(old)[2], ts, "timeout"))
                    continue
                key = tuple(key)
                if not phase:
                    table[key] = [ts, True, start]
                    clock.append((key, start))
                    continue
                if key not in table:
                    while len(table) >= most:
                        first, life = clock.popleft()
                        entry = table.get(first)
                        if entry is None or entry[2] != life:
                            continue  # that life has ended
                        if entry[1]:
                            entry[1] = False
                            clock.append((first, life))
                        else:
                            found.append((span, 1, None, *first, table.pop(first)[2], ts, "eviction"))
                    table[key] = [ts, True, frame]
                    clock.append((key, frame))
                    if len(clock) > 2 * most:  # most are of lives that sweeps ended
                        clock = deque(x for x in clock if x[0] in table and table[x[0]][2] == x[1])
                entry = table[key]
                entry[0], entry[1] = max(entry[0], ts), True
                found.append((span, 0, frame, *key, entry[2], None, None))
            if found:
                yield out(found)
        if table:
            yield out(held())

    return in_order(rows, ["phase", "frame_no", "kind"], "span", list(range(1, spans + 1)), run, schema)


def admitted(packets: DataFrame, swept: DataFrame | None, max_flows: int, timeout_us: int = 0) -> DataFrame:
    """A table of at most ``max_flows`` flows (0: no bound), exactly as frame order makes it: packets' frame_no and key with
    ``instance``, the number of the flow's life, and the end of that life, ended_us and reason (timeout or
    eviction), both null for lives that last. Before a new flow enters a full table, the second-chance clock
    evicts one: flows wait in the order in which they came, and one that was seen since the clock passed it
    waits once more. Sweeps (frame_no, sweep_us) come after their frame."""
    if swept is None or not timeout_us:
        swept, timeout_us = None, 0
    columns = [c for c in ("frame_no", "ts_us", "watermark_us", *KEY) if c in packets.columns]
    numbered = cut(instances(packets.select(*columns), swept, timeout_us), "numbered")
    whole = cut(_lives(numbered, swept, timeout_us, *KEY), "whole")
    spans = overload(whole, max_flows) if max_flows else []
    if not spans:
        return _told(numbered.join(whole.select(*KEY, "instance", "start"), [*KEY, "instance"]).drop("instance"), whole.select(*KEY, "start", "expired_us", _reason()))
    frame = F.col("frame_no")
    region = _span(frame, spans, False)
    parted = numbered.drop("instance").withColumn("region", region)
    inside = _within(F.col("region"), frame, spans)
    nothing = lambda t: F.lit(None).cast(t)

    # What the table holds when a span begins: lives that began by then and have not expired, with their last time so far.
    first = _span(F.col("start"), spans, False)  # the spans that begin before this life
    begins = F.get(F.array(*(F.lit(a) for a, _ in spans), F.lit(_NEVER)), first)
    alive = whole.select(*KEY, "instance", "start", "end", begins.alias("a"), (first + 1).alias("span")).filter(f"a <= end and a < {_NEVER}")
    holds = numbered.join(alive, [*KEY, "instance"]).filter("frame_no <= a").groupBy("span", *KEY, "start").agg(F.max("ts_us").alias("ts_us"))
    rows = holds.select("span", F.lit(0).alias("phase"), F.col("start").alias("frame_no"), F.lit(0).alias("kind"), "ts_us", *KEY, "start")
    rows = rows.unionByName(parted.filter(inside).select(F.col("region").alias("span"), F.lit(1).alias("phase"), "frame_no", F.lit(0).alias("kind"), "ts_us", *KEY, nothing("long").alias("start")))
    if swept is not None:
        marks = swept.withColumn("region", _span(frame, spans, True)).filter(inside)
        types = {c: numbered.schema[c].dataType for c in KEY}
        rows = rows.unionByName(marks.select(F.col("region").alias("span"), F.lit(1).alias("phase"), "frame_no", F.lit(1).alias("kind"), F.col("sweep_us").alias("ts_us"), *(nothing(t).alias(c) for c, t in types.items()), nothing("long").alias("start")))
    replayed = cut(_replay(rows, {c: numbered.schema[c].dataType.simpleString() for c in KEY}, max_flows, timeout_us, len(spans)), "replayed")

    # All other frames: after a span flows go on with what was held.
    stops = F.get(F.array(*(F.lit(b) for _, b in spans)), F.col("span") - 1)
    rest = parted.filter(~inside).withColumn("start", nothing("long"))
    kept = replayed.filter("what = 2").select("ts_us", *KEY, F.col("span").alias("region"), "start", stops.alias("frame_no")).filter(frame < _NEVER)
    if "watermark_us" in rest.columns:
        kept = kept.withColumn("watermark_us", F.col("ts_us"))
    key = (*KEY, "region")
    rest = cut(instances(rest.unionByName(kept), swept, timeout_us, key), "rest")
    lived = _lives(rest, swept, timeout_us, *key)
    closes = F.get(F.array(*(F.lit(a) for a, _ in spans), F.lit(_NEVER)), F.col("region"))  # a span decides from its first frame on
    lived = cut(lived.withColumn("expired_us", F.when(F.col("end") < closes, F.col("expired_us"))), "lived")
    real = rest.filter("start is null").drop("start").join(lived.select(*key, "instance", "start"), [*key, "instance"]).select("frame_no", *KEY, "start")
    frames = real.unionByName(replayed.filter("what = 0").select("frame_no", *KEY, "start"))
    over = replayed.filter("what > 0").select(*KEY, "start", F.when(F.col("what") == 1, F.col("ts_us")).alias("expired_us"), "reason")
    ends = lived.select(*KEY, "start", "expired_us", _reason()).unionByName(over)
    return _told(frames, ends)


def _reason() -> Column:
    return F.when(F.col("expired_us").isNotNull(), "timeout").alias("reason")


def _told(frames: DataFrame, ends: DataFrame) -> DataFrame:
    """Frames with the number and end of their life; a life is told by its key and first frame."""
    # Dealt first: hardly any life has two rows, so aggregates ahead of the exchange would only sort what a task reads.
    one = ends.repartition(*KEY).groupBy(*KEY, "start").agg(F.max(F.struct("expired_us", "reason")).alias("end"))
    lives = one.select(*KEY, "start", (F.row_number().over(Window.partitionBy(*KEY).orderBy("start")) - 1).cast("long").alias("instance"), F.col("end.expired_us").alias("ended_us"), F.col("end.reason").alias("reason"))
    return frames.join(lives, [*KEY, "start"]).select("frame_no", *KEY, "instance", "ended_us", "reason")
