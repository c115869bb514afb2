"""The alert folds over a stream of packet rows: state by detector key, dropped once it can't matter.

Time is that of a key's own rows, sorted within a micro-batch, not the watermark of all frames; rows later than
``late`` are dropped by Spark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators.detectors import SCAN_KEY, SYN_KEY, PortScan, SynFlood

ALERT = "ts_us long, observed_total long, observed_values long, observed_hosts long"


def _alerts(seen: DataFrame, keys, values: list[str], make, keep_us: int, late: str) -> DataFrame:
    timed = seen.withColumn("ts", F.timestamp_micros(F.col("ts_us"))).withWatermark("ts", late)
    kinds = ", ".join(f"{k} {seen.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        detector, top = pickle.loads(state.get[0]) if state.exists else (make(), 0)
        found = []
        for row in pd.concat(parts).sort_values(["ts_us", "frame_no"])[["frame_no", "ts_us", *values]].itertuples(index=False):
            top = max(top, int(row.ts_us))
            found += [(*key, *alert) for alert in detector.take(int(row.frame_no), top, int(row.ts_us), *row[2:])]
        state.update((pickle.dumps((detector, top)),))
        state.setTimeoutTimestamp(max((top + keep_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        if found:
            yield pd.DataFrame(found, columns=[*keys, *(c.split()[0] for c in ALERT.split(", "))]).astype(dict.fromkeys(("observed_total", "observed_hosts"), "Int64"))

    columns = timed.select(*keys, "ts", "frame_no", "ts_us", *values)
    return columns.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {ALERT}", "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def syn_flood_alerts(packets: DataFrame, window_us: int = 5_000_000, total: int = 200, sources: int = 50, cooldown_us: int = 10_000_000, late: str = "10 seconds") -> DataFrame:
    return _alerts(packets.filter("syn and not ack"), SYN_KEY, ["src_ip"], lambda: SynFlood(window_us, total, sources, cooldown_us), window_us + cooldown_us, late)


def port_scan_alerts(packets: DataFrame, window_us: int = 10_000_000, ports: int = 25, hosts: int = 10, cooldown_us: int = 30_000_000, late: str = "10 seconds") -> DataFrame:
    seen = packets.filter("protocol = 'udp' or (protocol = 'tcp' and syn and not ack)")
    return _alerts(seen, SCAN_KEY, ["dst_port", "dst_ip"], lambda: PortScan(window_us, ports, hosts, cooldown_us), window_us + cooldown_us, late)
