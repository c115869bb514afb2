"""SYN-flood and port-scan detectors: sliding windows of event time over detector keys.

Two steps. Aggregates over slots of time first find the keys that can reach a threshold at all, a
superset; only those keys go through a fold. The alert folds know cooldowns and late rows, so a key is one
task; the plain window counts are dealt by key and slot. Keys are detector keys, not flows, so the work
spreads over the cluster and results are global.
"""

from __future__ import annotations

from collections import Counter, deque
from functools import partial
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.folds import fold

SYN_KEY, SCAN_KEY = ("dst_ip", "dst_port"), ("src_ip",)
#: Records that a key keeps; the oldest goes first.
RECORDS = 4096
ALERT = {c: "long" for c in ("ts_us", "observed_total", "observed_values", "observed_hosts")}


def _slots(seen: DataFrame, window_us: int) -> DataFrame:
    """seen with ``slot``: time is cut into slots as long as a window, so a window lies in two neighbours."""
    return seen.withColumn("slot", F.floor(F.col("watermark_us") / max(window_us, 1)))


def _busy(seen: DataFrame, keys, window_us: int, counted: dict[str, str]) -> DataFrame:
    """For each key the most that two neighbouring slots hold together: n, and for each of ``counted`` (name,
    column) the sum of both slots' distinct values. No window holds more. Partial aggregates throughout."""
    slots = _slots(seen, window_us)
    parts = None
    for name, column in counted.items():
        one = slots.groupBy(*keys, "slot", column).agg(F.count("*").alias("n")).groupBy(*keys, "slot").agg(F.sum("n").alias("n"), F.count("*").alias(name))
        parts = one if parts is None else parts.join(one.drop("n"), [*keys, "slot"])
    both = parts.withColumn("slot", F.col("slot") + 1).unionByName(parts).groupBy(*keys, "slot").agg(*(F.sum(c).alias(c) for c in ("n", *counted)))
    return both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("n", *counted)))


def syn_keys(packets: DataFrame, window_us: int, total: int, sources: int) -> DataFrame:
    """Targets that can reach both thresholds at all: a superset of those that do."""
    return _busy(packets.filter("syn and not ack"), SYN_KEY, window_us, {"n_sources": "src_ip"}).filter((F.col("n") >= total) & (F.col("n_sources") >= sources)).select(*SYN_KEY)


def scan_keys(packets: DataFrame, window_us: int, ports: int, hosts: int) -> DataFrame:
    """Sources that can reach one of the thresholds (0: not used) at all."""
    busy = _busy(_scans(packets), SCAN_KEY, window_us, {"n_ports": "dst_port", "n_hosts": "dst_ip"})
    return busy.filter((F.lit(ports > 0) & (F.col("n_ports") >= ports)) | (F.lit(hosts > 0) & (F.col("n_hosts") >= hosts))).select(*SCAN_KEY)


def _scans(packets: DataFrame) -> DataFrame:
    return packets.filter("protocol = 'udp' or (protocol = 'tcp' and syn and not ack)")


class _Sliding:
    """Counts over the rows of a window that ends with the newest row."""

    def __init__(self, window: int, values: int):
        self.window, self.rows, self.counts, self.waiting = window, deque(), [Counter() for _ in range(values)], []

    def drop_before(self, least: int) -> None:
        while self.rows and self.rows[0][0] < least:
            for counter, value in zip(self.counts, self.rows.popleft()[1]):
                counter[value] -= 1
                if not counter[value]:
                    del counter[value]


def _counted(seen: DataFrame, keys, window_us: int, values: list[str], names: list[str]) -> DataFrame:
    """Key, frame_no and the counts over the window (inclusive at both ends, of watermark_us; rows of one
    watermark see each other) of each row. A key's rows are dealt by slot, each also to the next one, where it
    is context: a task holds a window of a key, however many rows that key has."""
    slots = _slots(seen.select(*keys, "frame_no", "watermark_us", *(F.col(v).alias(f"__{i}") for i, v in enumerate(values))), window_us)
    here = F.explode(F.array(F.struct(F.col("slot").alias("at"), F.lit(False).alias("context")), F.struct((F.col("slot") + 1).alias("at"), F.lit(True).alias("context"))))
    dealt = slots.select("*", here.alias("s")).drop("slot").select("*", F.col("s.at").alias("slot"), F.col("s.context").alias("context")).drop("s")
    inner = [f"__{i}" for i in range(len(values))]

    def step(state: _Sliding, mark: int, frame: int, context: bool, *own):
        done = finish(state) if state.waiting and state.waiting[0][0] != mark else []
        state.drop_before(mark - window_us)
        state.rows.append((mark, own))
        for counter, value in zip(state.counts, own):
            counter[value] += 1
        if not context:
            state.waiting.append((mark, frame))
        return done

    def finish(state: _Sliding) -> list[tuple]:
        sizes = (len(state.rows), *map(len, state.counts))
        done = [(frame, *sizes) for _, frame in state.waiting]
        state.waiting = []
        return done

    result = {"frame_no": "long", "n": "long", **{c: "long" for c in names}}
    return fold(dealt, [*keys, "slot"], ["watermark_us", "frame_no", "context", *inner], result, partial(_Sliding, window_us, len(values)), step, lambda state: finish(state), many=True).drop("slot")


def syn_candidates(packets: DataFrame, window_us: int, total: int, sources: int) -> DataFrame:
    """Key, frame_no, n and n_sources of the initial SYNs whose window reaches both thresholds, cooldowns aside."""
    seen = packets.filter("syn and not ack").join(syn_keys(packets, window_us, total, sources), list(SYN_KEY), "left_semi")
    return _counted(seen, SYN_KEY, window_us, ["src_ip"], ["n_sources"]).filter((F.col("n") >= total) & (F.col("n_sources") >= sources))


def scan_candidates(packets: DataFrame, window_us: int, ports: int, hosts: int) -> DataFrame:
    """Key, frame_no, n_ports and n_hosts of the UDP packets and initial SYNs whose source reaches one of the
    thresholds (0: not used)."""
    seen = _scans(packets).join(scan_keys(packets, window_us, ports, hosts), list(SCAN_KEY), "left_semi")
    counted = _counted(seen, SCAN_KEY, window_us, ["dst_port", "dst_ip"], ["n_ports", "n_hosts"]).drop("n")
    return counted.filter((F.lit(ports > 0) & (F.col("n_ports") >= ports)) | (F.lit(hosts > 0) & (F.col("n_hosts") >= hosts)))


class SynFlood:
    """A target's recent initial SYNs: at most RECORDS, in the order in which they came."""

    def __init__(self, window: int, total: int, sources: int, cooldown: int):
        self.window, self.total, self.needed, self.cooldown = window, total, sources, max(cooldown, 0)
        self.kept: dict[int, object] = {}  # by number, oldest first
        self.times: list[tuple[int, int]] = []  # a heap of time and number
        self.sources, self.quiet = Counter(), None

    def drop(self, number: int) -> None:
        source = self.kept.pop(number)
        self.sources[source] -= 1
        if not self.sources[source]:
            del self.sources[source]

    def take(self, frame: int, now: int, ts: int, source) -> list[tuple]:
        if self.quiet is not None and self.quiet > now:
            return []
        while self.times and (self.times[0][0] < now - self.window or self.times[0][1] not in self.kept):
            number = heappop(self.times)[1]
            if number in self.kept:
                self.drop(number)
        if now - ts > self.window:
            return []
        self.kept[frame] = source
        self.sources[source] += 1
        heappush(self.times, (ts, frame))
        if len(self.kept) > RECORDS:
            self.drop(next(iter(self.kept)))
        if len(self.kept) < self.total or len(self.sources) < self.needed:
            return []
        self.quiet = now + self.cooldown
        return [(ts, len(self.kept), len(self.sources), None)]


class _Latest:
    """Values with the latest time of each; those before a time can be dropped."""

    def __init__(self):
        self.last, self.heap, self.count = {}, [], 0

    def drop_before(self, least: int) -> None:
        while self.heap and self.heap[0][0] < least:
            _, number, value = heappop(self.heap)
            if self.last[value] < least:
                del self.last[value]
            else:  # seen again since
                heappush(self.heap, (self.last[value], number, value))

    def add(self, value, ts: int) -> None:
        if value not in self.last:
            self.count += 1
            heappush(self.heap, (ts, self.count, value))
        self.last[value] = max(ts, self.last.get(value, ts))


class PortScan:
    """A source's recent target ports and hosts."""

    def __init__(self, window: int, ports: int, hosts: int, cooldown: int):
        self.window, self.limits, self.cooldown = window, (ports, hosts), max(cooldown, 0)
        self.seen, self.quiet = (_Latest(), _Latest()), None

    def take(self, _frame: int, now: int, ts: int, port, host) -> list[tuple]:
        if self.quiet is not None and self.quiet > now:
            return []
        for values, value in zip(self.seen, (port, host)):
            values.drop_before(now - self.window)
            if now - ts <= self.window:
                values.add(value, ts)
        counts = [len(x.last) for x in self.seen]
        if now - ts > self.window or not any(limit and n >= limit for limit, n in zip(self.limits, counts)):
            return []
        self.quiet = now + self.cooldown
        return [(ts, None, *counts)]


def _alerts(packets: DataFrame, candidates: DataFrame, keys, values, detector, settings, kind: str) -> DataFrame:
    chosen = packets.join(candidates, list(keys), "left_semi")
    found = fold(chosen, list(keys), ["frame_no", "watermark_us", "ts_us", *values], ALERT, partial(detector, *settings), detector.take, lambda state: None)
    return found.withColumn("kind", F.lit(kind)).withColumn("schema_version", F.lit(1))


def syn_flood_alerts(packets: DataFrame, window_us: int = 5_000_000, total: int = 200, sources: int = 50, cooldown_us: int = 10_000_000) -> DataFrame:
    """packets: with watermark_us over all frames, also those that are no SYN."""
    settings = (window_us, total, sources, cooldown_us)
    return _alerts(packets.filter("syn and not ack"), syn_keys(packets, window_us, total, sources), SYN_KEY, ["src_ip"], SynFlood, settings, "syn_flood")


def port_scan_alerts(packets: DataFrame, window_us: int = 10_000_000, ports: int = 25, hosts: int = 10, cooldown_us: int = 30_000_000) -> DataFrame:
    settings = (window_us, ports, hosts, cooldown_us)
    return _alerts(_scans(packets), scan_keys(packets, window_us, ports, hosts), SCAN_KEY, ["dst_port", "dst_ip"], PortScan, settings, "port_scan")
