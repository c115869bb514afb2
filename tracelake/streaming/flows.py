"""Flows and ticks over a stream of packet rows, with event-time watermarks.

State is kept for as long as packets may be late. Results appear once the watermark has passed, at the
grain of micro-batches, so they differ from the batch operators where those follow single frames: a flow
ends here by a gap of at least the timeout in its own packets, whether or not another frame caused a sweep.
Packets later than ``late`` are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.flows import KEY, eligible, with_key


def keyed(packets: DataFrame, late: str) -> DataFrame:
    """Packets of flows with their canonical key, and ts with its watermark."""
    timed = eligible(packets).withColumn("ts", F.timestamp_micros(F.col("ts_us"))).withWatermark("ts", late)
    return with_key(timed)


def ended_flows(packets: DataFrame, timeout: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Volumes of each flow that was idle for the timeout; append mode."""
    ab, size = F.col("a_to_b"), F.col("wire_len")
    grouped = keyed(packets, late).groupBy(F.session_window("ts", timeout).alias("life"), *KEY).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(ab).alias("packets_a_to_b"), F.count_if(~ab).alias("packets_b_to_a"),
        F.sum(F.when(ab, size).otherwise(0)).alias("bytes_a_to_b"), F.sum(F.when(ab, 0).otherwise(size)).alias("bytes_b_to_a"),
    )
    return grouped.withColumns({
        "packets_total": F.col("packets_a_to_b") + F.col("packets_b_to_a"), "bytes_total": F.col("bytes_a_to_b") + F.col("bytes_b_to_a"),
        "duration_secs": (F.col("last_us") - F.col("first_us")) / 1e6, "expired_at": F.col("life.end"),
    }).drop("life")


def ticks(packets: DataFrame, every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Bytes, packets and active flows of each interval; append mode. Two chained aggregates: flows of an
    interval first, so no set of flows is held by one key."""
    per_flow = keyed(packets, late).groupBy(F.window("ts", every).alias("w"), *KEY).agg(F.sum("wire_len").alias("bytes"), F.count("*").alias("packets"))
    whole = per_flow.groupBy(F.window(F.window_time("w"), every).alias("tick")).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("active_flows"))
    seconds = F.greatest((F.unix_micros("tick.end") - F.unix_micros("tick.start")) / 1e6, F.lit(0.001))
    return whole.select(F.col("tick.start").alias("start"), "bytes", "packets", "active_flows", (F.col("bytes") * 8 / seconds / 1e6).alias("mbps"), (F.col("packets") / seconds).alias("pps"))
