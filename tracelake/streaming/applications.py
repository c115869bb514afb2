"""TCP and DNS state of flows over a stream of packet rows: keyed state with types, and timers in event time.

A flow's state is a row of numbers and a list of what waits: at most 128 segments a side, or 32 queries. Packets of a
micro-batch are taken in frame order, so a stream that brings frames in order ends with the results of the batch
operators. A flow that was idle for the timeout gives its row and is forgotten; its timer moves with its packets. State
lives in RocksDB, so it may be larger than memory. Packets later than ``late`` are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelake.operators import dns, tcp
from tracelake.operators.flows import KEY
from tracelake.streaming.flows import keyed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: From so many packets of a flow in a micro-batch on they are computed together.
TOGETHER = 64
_ARROW_KIND = {"string": "string", "long": "Int64", "double": "Float64"}


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB state store; another one that keeps them may be set before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(name, "") or spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, PROVIDER)


class _Timed(StatefulProcessor):
    """A processor with one row of numbers, one list, and a timer that follows the newest packet."""

    numbers = waiting = ""
    result: dict[str, str] = {}

    def __init__(self, idle_us: int, kinds: list[str]):
        self.idle_us, self.kinds = idle_us, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("numbers", f"{self.numbers}, newest long")
        self.list = handle.getListState("waiting", self.waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(rows)).sort_values(["frame_no", "ts_us"])
        if self.row.exists():
            *own, newest = self.row.get()
            flow = self.load(own, list(self.list.get()) if self.list.exists() else [])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            flow, newest = self.fold(), -(1 << 62)
        flow = self.take(flow, whole)
        newest = max(newest, int(whole.ts_us.max()))
        own, waiting = self.save(flow)
        self.row.update((*own, newest))
        if waiting:
            self.list.put(waiting)
        else:
            self.list.clear()
        self.handle.registerTimer(max((newest + self.idle_us) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *own, newest = self.row.get()
        found = self.load(own, list(self.list.get()) if self.list.exists() else []).result()
        self.row.clear()
        self.list.clear()
        if found is not None:
            columns = [*KEY, *self.result, "last_us"]
            out = pd.DataFrame([(*key, *found, newest)], columns=columns)
            yield out.astype({**{c: _ARROW_KIND[t] for c, t in self.result.items()}, "last_us": "Int64"})

    def close(self) -> None:
        pass


class TcpState(_Timed):
    numbers = "state string, client string, closed int, retransmissions long, out_of_order long, samples long, last double, least double, smooth double, top_b long, top_a long, acked_b long, acked_a long"
    waiting = "side int, end long, ts long"
    result, fold = tcp.RESULT, tcp.Flow

    def load(self, own, waiting) -> tcp.Flow:
        flow = tcp.Flow()
        flow.state, flow.client, closed, flow.retransmissions, flow.out_of_order, flow.samples, flow.last, flow.least, flow.smooth, *rest = own
        flow.closed_sides, flow.top, flow.acked = {s for s in (0, 1) if closed >> s & 1}, list(rest[:2]), list(rest[2:])
        for side, end, ts in waiting:
            flow.waiting[side].append((end, ts))
        return flow

    def save(self, flow: tcp.Flow) -> tuple:
        own = (flow.state, flow.client, sum(1 << s for s in flow.closed_sides), flow.retransmissions, flow.out_of_order, flow.samples, flow.last, flow.least, flow.smooth, *flow.top, *flow.acked)
        return own, [(s, end, ts) for s in (0, 1) for end, ts in flow.waiting[s]]

    def take(self, flow: tcp.Flow, rows: pd.DataFrame) -> tcp.Flow:
        columns = [rows[c].fillna(False).to_numpy(bool) if c in ("syn", "ack", "fin", "rst") else rows[c].fillna(0).to_numpy(np.int64) for c in tcp.COLUMNS]
        if len(rows) >= TOGETHER:
            return tcp.Batch(columns, np.zeros(1, np.int64), flow).carry()
        for row in zip(*(c.tolist() for c in columns)):
            flow.take(*row)
        return flow


class DnsState(_Timed):
    numbers = "seen boolean, queries long, matched long, refused long, nxdomain long, servfail long, least double, mean double, most double, top long"
    waiting = "dns_id long, forward boolean, question binary, ts long"
    result, fold = dns.RESULT, dns.Flow

    def load(self, own, waiting) -> dns.Flow:
        flow = dns.Flow()
        flow.seen, flow.queries, flow.matched, flow.refused, flow.nxdomain, flow.servfail, flow.least, flow.mean, flow.most, flow.top = own
        flow.waiting = [(i, forward, None if question is None else bytes(question), ts) for i, forward, question, ts in waiting]
        return flow

    def save(self, flow: dns.Flow) -> tuple:
        own = (flow.seen, flow.queries, flow.matched, flow.refused, flow.nxdomain, flow.servfail, flow.least, flow.mean, flow.most, flow.top)
        return own, [tuple(q) for q in flow.waiting]

    def take(self, flow: dns.Flow, rows: pd.DataFrame) -> dns.Flow:
        names = ["frame_no", "ts_us", "watermark_us", "a_to_b", "dns_id", "response", "rcode", "question", "complete"]
        top = getattr(flow, "top", None)
        for values in rows[names].itertuples(index=False):
            frame, ts, mark, forward, ident, response, rcode, question, complete = values
            top = max(ts, top if top is not None else ts) if pd.isna(mark) else mark
            flow.take(int(frame), int(ts), int(top), bool(forward), int(ident), bool(response), int(rcode), None if question is None else bytes(question), bool(complete))
        flow.top = int(top)
        return flow


def _ended(rows: DataFrame, columns: list[str], processor: type[_Timed], idle: str, late: str) -> DataFrame:
    spark = rows.sparkSession
    use_rocksdb(spark)
    idle_us = int(spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {idle}) AS n").first().n)
    kinds = [rows.schema[c].dataType.simpleString() for c in KEY]
    schema = ", ".join([*(f"{c} {t}" for c, t in zip(KEY, kinds)), *(f"{c} {t}" for c, t in processor.result.items()), "last_us long"])
    return rows.select(*KEY, "ts", *columns).groupBy(*KEY).transformWithStateInPandas(processor(idle_us, kinds), schema, "append", "eventTime")


def tcp_flows(packets: DataFrame, idle: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """The columns of ``operators.tcp.RESULT`` and last_us of each TCP flow that was idle; append mode. packets: a stream of
    decoded rows with frame_no."""
    rows = keyed(packets.filter("protocol = 'tcp'"), late)
    return _ended(rows, ["frame_no", *tcp.COLUMNS], TcpState, idle, late)


def dns_flows(messages: DataFrame, idle: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """The columns of ``operators.dns.RESULT`` and last_us of each flow that asked something, once it was idle; append mode.
    messages: as ``operators.dns.dns_flows`` takes them, as a stream. Without watermark_us queries wait by the time of
    the flow's own packets."""
    if "watermark_us" not in messages.columns:
        messages = messages.withColumn("watermark_us", F.lit(None).cast("long"))
    timed = dns.usable(messages).withColumn("ts", F.timestamp_micros(F.col("ts_us"))).withWatermark("ts", late)
    return _ended(timed, ["frame_no", "ts_us", "watermark_us", "a_to_b", "dns_id", "response", "rcode", "question", "complete"], DnsState, idle, late)
