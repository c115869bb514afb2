"""Flow keys, flow aggregates, capture-time expiry and rankings over packet rows.

A packet row has frame_no, ts_us, protocol, src_ip, src_port, dst_ip, dst_port, wire_len. frame_no is unique.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.folds import fold
from tracelake.operators.sweeps import sweeps  # noqa: F401
from tracelake.sources.ordered import in_order
from tracelake.sources.tables import cut

KEY = ("protocol", "a_ip", "a_port", "b_ip", "b_port")
#: Frames whose running maxima and sweep look-ups are computed together.
CHUNK = 1 << 16
#: Time in which ends of flows and sweeps meet.
SLOT_US = 60_000_000


def eligible(packets: DataFrame) -> DataFrame:
    """Packets that belong to a flow: TCP or UDP with both endpoints."""
    return packets.filter(F.col("protocol").isin("tcp", "udp") & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())


def with_key(packets: DataFrame) -> DataFrame:
    """The canonical key: the smaller endpoint (address, then port) is a."""
    forward = F.struct("src_ip", "src_port") <= F.struct("dst_ip", "dst_port")
    pick = lambda yes, no: F.when(F.col("a_to_b"), F.col(yes)).otherwise(F.col(no))
    out = packets.withColumn("a_to_b", forward)
    return out.withColumns({"a_ip": pick("src_ip", "dst_ip"), "a_port": pick("src_port", "dst_port"), "b_ip": pick("dst_ip", "src_ip"), "b_port": pick("dst_port", "src_port")})


def aggregate(packets: DataFrame, *more_keys: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row a flow: times, packets and bytes by direction, totals, duration and mean bit rate, and ``also``."""
    ab = F.col("a_to_b")
    grouped = packets.groupBy(*KEY, *more_keys).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count_if(ab).alias("packets_a_to_b"), F.count_if(~ab).alias("packets_b_to_a"),
        F.sum(F.when(ab, F.col("wire_len")).otherwise(0)).alias("bytes_a_to_b"), F.sum(F.when(ab, 0).otherwise(F.col("wire_len"))).alias("bytes_b_to_a"), *also,
    )
    total = grouped.withColumns({"packets_total": F.col("packets_a_to_b") + F.col("packets_b_to_a"), "bytes_total": F.col("bytes_a_to_b") + F.col("bytes_b_to_a")})
    seconds = (F.col("last_us") - F.col("first_us")) / 1e6
    return total.withColumn("duration_secs", seconds).withColumn("avg_bps", F.when(F.col("duration_secs") > 0, F.col("bytes_total") * 8 / F.col("duration_secs")).otherwise(0.0))


def top_n(flows: DataFrame, n: int, by: str = "bytes_total") -> DataFrame:
    """The n largest; ties by key, zero rows left out."""
    return flows.filter(F.col(by) > 0).orderBy(F.desc(by), *KEY).limit(n)


def with_watermark(frames: DataFrame) -> DataFrame:
    """frames with watermark_us, the largest time up to each frame. Two numbers a frame are dealt by chunks of frames:
    maxima of the chunks before, then inside. A frame that is not behind has its own time as the watermark, so only
    late frames are joined back; where they are few, which is read off their table, Spark broadcasts them and the
    frames themselves, with payloads, stay where they are."""
    frames = frames.drop("watermark_us")
    chunked = frames.select("frame_no", "ts_us", F.floor(F.col("frame_no") / CHUNK).alias("chunk"))
    own = chunked.groupBy("chunk").agg(F.max("ts_us").alias("top"))
    # One row a chunk, so a single task is enough for the running maximum.
    before = own.select("chunk", F.max("top").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    inside = F.max("ts_us").over(Window.partitionBy("chunk").orderBy("frame_no"))
    marked = chunked.withColumn("inside", inside).join(before, "chunk").select("frame_no", "ts_us", F.greatest("inside", "carry").alias("watermark_us"))
    late = cut(marked.filter("ts_us < watermark_us").select("frame_no", "watermark_us"), "late")
    return frames.join(late, "frame_no", "left").withColumn("watermark_us", F.coalesce("watermark_us", "ts_us"))


def instances(packets: DataFrame, swept: DataFrame, timeout_us: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """packets with ``instance``, the number of the flow's life. A flow ends at the first sweep that finds
    it idle for longer than timeout_us (0: never). A gap alone doesn't end it: a frame is seen before
    the sweep that it causes.

    Window functions number the lives of flows whose times never decrease. A flow with a frame behind the
    watermark (watermark_us, without which times must not decrease within a key) needs the largest time of
    the life so far, which starts anew with each life: these flows go through a fold."""
    if not timeout_us:
        return packets.withColumn("instance", F.lit(0).cast("long"))
    looked_up = _last_sweep(packets, swept)
    if "watermark_us" not in packets.columns:
        return _split(looked_up, timeout_us, key)
    late = packets.filter("ts_us < watermark_us").select(*key).distinct()
    rows = looked_up.join(late, list(key), "left_semi")
    lives_of = fold(rows, list(key), ["frame_no", "ts_us", "swept_us", "swept_at"], {"frame_no": "long", "instance": "long"}, lambda: [None, 0, -1], partial(_next_life, timeout_us), lambda state: None)
    crooked = rows.drop("swept_us", "swept_at").join(lives_of, [*key, "frame_no"])
    return _split(looked_up.join(late, list(key), "left_anti"), timeout_us, key).unionByName(crooked)


def _next_life(timeout_us: int, state: list, frame: int, ts: int, swept: int | None, swept_at: int | None) -> list[tuple]:
    """state: the largest time of the life, its number, and its last frame. A sweep before that frame has no say."""
    if state[0] is not None and swept is not None and swept_at >= state[2] and swept - state[0] > timeout_us:
        state[:2] = None, state[1] + 1
    state[0], state[2] = ts if state[0] is None else max(state[0], ts), frame
    return [(frame, state[1])]


def _last_sweep(packets: DataFrame, swept: DataFrame) -> DataFrame:
    """packets with swept_us and swept_at, the watermark and the frame of the last sweep at a frame before."""
    chunk = F.floor(F.col("frame_no") / CHUNK).alias("chunk")
    none = F.lit(None).cast("long")
    marks = packets.withColumns({"sweep_us": none, "at": none}).unionByName(swept.select("frame_no", "sweep_us", F.col("frame_no").alias("at")), allowMissingColumns=True).withColumn("chunk", chunk)
    # A sweep at a frame comes after that frame's packet. Watermarks of sweeps grow with their frames, so maxima give the last.
    order = Window.partitionBy("chunk").orderBy("frame_no", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    # Every chunk of packets gets the last sweep of the chunks before it.
    tops = marks.groupBy("chunk").agg(F.max("sweep_us").alias("sweep_us"), F.max("at").alias("at"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("chunk", *(F.max(c).over(before).alias("carry_" + c) for c in ("sweep_us", "at")))
    known = marks.withColumns({"in_" + c: F.max(c).over(order) for c in ("sweep_us", "at")}).filter("at is null").join(carry, "chunk")
    last = {"swept_us": F.coalesce("in_sweep_us", "carry_sweep_us"), "swept_at": F.coalesce("in_at", "carry_at")}
    return known.withColumns(last).drop("in_sweep_us", "in_at", "carry_sweep_us", "carry_at", "chunk", "sweep_us", "at")


def _split(seen: DataFrame, timeout_us: int, key: tuple[str, ...]) -> DataFrame:
    per_key = Window.partitionBy(*key).orderBy("frame_no")
    split = F.coalesce(F.col("swept_us") - F.lag("ts_us").over(per_key) > timeout_us, F.lit(False))
    return seen.withColumn("__split", split.cast("long")).withColumn("instance", F.sum("__split").over(per_key)).drop("__split", "swept_us", "swept_at")


def lives(packets: DataFrame, swept: DataFrame, timeout_us: int) -> DataFrame:
    """Flow aggregates of every life of every flow, with expired_us: the sweep that ended it, else null."""
    # A frame behind the watermark is seen by sweeps after it only.
    seen = F.max("watermark_us" if "watermark_us" in packets.columns else "ts_us").alias("seen_us")
    flows = aggregate(instances(packets, swept, timeout_us), "instance", also=(seen,))
    if not timeout_us:
        flows = flows.drop("seen_us")
        return flows.withColumn("expired_us", F.lit(None).cast("long"))
    return ended(cut(flows, "lives"), swept, timeout_us)  # read twice, one row a life


def ended(flows: DataFrame, swept: DataFrame, timeout_us: int) -> DataFrame:
    """flows (with last_us and seen_us, the time from which sweeps see the last frame) with expired_us."""
    # The first sweep later than last_us + timeout_us. Time is cut into slots, of which each holds at most
    # SLOT / 1 s sweeps; a flow looks in its own slot's sorted list, else takes the first sweep of a later one.
    due = F.greatest(F.col("last_us") + timeout_us, F.col("seen_us"))
    slot = lambda c: F.floor(c / SLOT_US).alias("slot")
    marks = swept.groupBy(slot(F.col("sweep_us"))).agg(F.sort_array(F.collect_set("sweep_us")).alias("marks"))
    slots = marks.select("slot", "marks").unionByName(flows.select(slot(due)).distinct(), allowMissingColumns=True).groupBy("slot").agg(F.first("marks", ignorenulls=True).alias("marks"))
    later = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # one row a slot that has a sweep or an end
    nexts = slots.withColumn("next", F.min(F.get("marks", F.lit(0))).over(later))
    inside = F.get(F.filter("marks", lambda m: m > due), F.lit(0))
    return flows.withColumn("slot", slot(due)).join(nexts, "slot", "left").withColumn("expired_us", F.coalesce(inside, "next")).drop("slot", "marks", "next", "seen_us")


def ticks(packets: DataFrame, every_us: int) -> DataFrame:
    """Bytes, packets, rates and active flows of each interval of event time."""
    tick = F.floor(F.col("ts_us") / every_us)
    grouped = packets.groupBy(tick.alias("tick")).agg(F.sum("wire_len").alias("bytes"), F.count("*").alias("packets"), F.count_distinct(*KEY).alias("active_flows"))
    seconds = max(every_us / 1e6, 0.001)
    return grouped.withColumns({"mbps": F.col("bytes") * 8 / seconds / 1e6, "pps": F.col("packets") / seconds})


def tick_top_flows(packets: DataFrame, every_us: int, n: int) -> DataFrame:
    """The n flows with the most bytes of each interval, ranked; ties by key."""
    tick = F.floor(F.col("ts_us") / every_us).alias("tick")
    sums = packets.groupBy(tick, *KEY).agg(F.sum("wire_len").alias("delta_bytes")).filter("delta_bytes > 0")
    rank = F.row_number().over(Window.partitionBy("tick").orderBy(F.desc("delta_bytes"), *KEY))
    return sums.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= n)


def reported_deltas(packets: DataFrame, every_us: int, n: int) -> DataFrame:
    """The n flows of each interval with the most bytes since they were last reported, ranked; ties by key. Only
    reported flows start anew, so a flow's bytes add up until it is among the n.

    Sums come first, by partial aggregation. What is reported depends on all reports before, so one task
    goes through the intervals, with the open sums held, but only of flows that can be reported (see _reportable);
    others have sorted its rows."""
    tick = F.floor(F.col("ts_us") / every_us).alias("tick")
    sums = cut(packets.groupBy(tick, *KEY).agg(F.sum("wire_len").alias("bytes")), "sums")
    sums = _reportable(sums, n)
    names = ["tick", *KEY]
    schema = ", ".join([*(f"{c} {sums.schema[c].dataType.simpleString()}" for c in names), "delta_bytes long, rank long"])

    def run(batches):
        pending, now, kinds = {}, None, None

        def report():
            best = heapq.nsmallest(n, ((-size, key) for key, size in pending.items() if size > 0))
            for _, key in best:
                del pending[key]
            columns = [[now] * len(best), *([key[i] for _, key in best] for i in range(len(KEY))), [-size for size, _ in best], list(range(1, len(best) + 1))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64(), pa.int64()])], names=[*names, "delta_bytes", "rank"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(names))]
            for own, *key, size, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if own != now and now is not None:
                    yield report()
                now = own
                pending[tuple(key)] = pending.get(tuple(key), 0) + size
        if now is not None:
            yield report()

    return in_order(sums.select(*names, "bytes", F.lit(0).alias("all")), ["tick", *KEY], "all", [0], run, schema)


def _reportable(sums: DataFrame, n: int) -> DataFrame:
    """Those of sums (tick, key, bytes) whose flows can ever be among the n reported.

    Before the i-th interval at most n * (i - 1) flows were reported; all others still have all their bytes open. So
    what is reported in it has the n * i largest running totals, resets left out. A lower bound of the n * i-th
    largest is read off a histogram of running totals, which changes by a row where a total enters another bucket: two numbers
    an interval and bucket that changes, however many flows there are. A flow stays if its total reaches the least bound that
    is still to come."""
    order = Window.partitionBy(*KEY).orderBy("tick")
    bucket = lambda c: F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * 16).cast("int")
    totals = sums.withColumn("total", F.sum("bytes").over(order)).withColumn("bucket", bucket(F.col("total")))
    moves = totals.select("tick", "bucket", F.lag("bucket").over(order).alias("was"))
    moved = moves.filter("was is null or was <> bucket")
    changes = moved.select("tick", "bucket", F.lit(1).alias("delta")).unionByName(moved.filter("was is not null").select("tick", F.col("was").alias("bucket"), F.lit(-1).alias("delta")))
    changes = changes.unionByName(sums.select("tick", F.lit(0).alias("bucket"), F.lit(0).alias("delta")).distinct())
    counts = changes.groupBy("tick", "bucket").agg(F.sum("delta").alias("delta"))

    def bounds(batches):
        held, ticks, least, now = {}, [], [], None

        def close():
            left, bound = n * (len(ticks) + 1), 0
            for b in sorted(held, reverse=True):
                left -= held[b]
                if left <= 0:
                    bound = b
                    break
            ticks.append(now)
            least.append(bound)

        for batch in batches:
            for own, b, delta in zip(*(c.to_pylist() for c in batch.columns)):
                if own != now and now is not None:
                    close()
                now, held[b] = own, held.get(b, 0) + delta
        if now is not None:
            close()
            floors = np.minimum.accumulate(np.array(least, np.int32)[::-1])[::-1]
            yield pa.RecordBatch.from_arrays([pa.array(ticks, pa.int64()), pa.array(floors, pa.int32())], names=["tick", "least"])

    # A row an interval and bucket, so a single task is enough.
    needed = counts.select(F.col("tick").cast("long").alias("tick"), "bucket", F.col("delta").cast("long").alias("delta")).repartition(1).sortWithinPartitions("tick").mapInArrow(bounds, "tick long, least int")
    able = F.max(F.col("bucket") >= F.col("least")).over(Window.partitionBy(*KEY))
    return totals.join(F.broadcast(cut(needed, "bounds")), "tick").withColumn("able", able).filter("able").select(*sums.columns)


def consumers(packets: DataFrame, asked: dict[str, tuple[int, int]]) -> DataFrame:
    """reported_deltas of several consumers, each (every_us, n) with reports of its own: what one has seen starts anew for
    that one alone. With the column consumer."""
    out = None
    for name, (every_us, n) in asked.items():
        own = reported_deltas(packets, every_us, n).withColumn("consumer", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def sampled(packets: DataFrame, rate: int) -> DataFrame:
    """Every rate-th frame of the capture; rate 0 gives none."""
    return packets.filter(F.lit(rate > 0) & (F.col("frame_no") % max(rate, 1) == 0))


def limited(packets: DataFrame, n: int) -> DataFrame:
    """The first n frames, all for n = 0."""
    return packets.orderBy("frame_no").limit(n) if n else packets


def first_name(packets: DataFrame, name: str) -> DataFrame:
    """The first non-null name of each flow, in frame order."""
    return packets.filter(F.col(name).isNotNull()).groupBy(*KEY).agg(F.min_by(name, "frame_no").alias(name))


def dns_transactions(messages: DataFrame, within_us: int = 5_000_000) -> DataFrame:
    """Queries with their responses: same flow, id and question, opposite direction, in time; each response
    and each query is used once. For traces without retransmitted queries; the fold covers the rest."""
    key = [*KEY, "dns_id", "question"]
    side = lambda want, names: messages.filter(F.col("response") == want).select(*key, *(F.col(c).alias(a) for c, a in names))
    asked = side(False, [("frame_no", "query_no"), ("ts_us", "query_us"), ("a_to_b", "q_ab")])
    told = side(True, [("frame_no", "response_no"), ("ts_us", "response_us"), ("a_to_b", "r_ab"), ("rcode", "rcode")])
    pairs = asked.join(told, key).filter((F.col("q_ab") != F.col("r_ab")) & (F.col("response_us") >= F.col("query_us")) & (F.col("response_us") - F.col("query_us") <= within_us))
    once = pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_no").orderBy("response_no"))).filter("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("response_no").orderBy("query_no"))).filter("n = 1").drop("n", "q_ab", "r_ab").withColumn("latency_us", F.col("response_us") - F.col("query_us"))


def addresses(number: Column) -> Column:
    """Dotted form of a 32-bit address."""
    part = lambda k: F.shiftrightunsigned(number, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(3), part(2), part(1), part(0))
