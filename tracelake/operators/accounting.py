"""Run accounting over decoded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def account(decoded: DataFrame) -> DataFrame:
    """One row: frames, bytes and what could be decoded. A frame counts once among the malformed or
    unsupported, whatever is wrong with it. An empty capture gives zeros and a null time."""
    bad, half, odd = F.col("parse_error").isNotNull(), F.col("transport_error").isNotNull(), F.coalesce("unsupported", F.lit(False))
    network = F.col("ip_version").isNotNull() | F.coalesce(F.col("protocol") == "arp", F.lit(False))
    return decoded.agg(
        F.count("*").alias("frames_read"), F.coalesce(F.sum("wire_len"), F.lit(0)).cast("long").alias("wire_bytes"), F.count_if(~bad).alias("parsed"), F.count_if(network).alias("with_network"),
        F.count_if(F.col("ip_version").isNotNull() & F.col("protocol").isNotNull()).alias("with_transport"), F.count_if(bad).alias("parse_errors"), F.count_if(half).alias("transport_errors"),
        F.count_if(odd).alias("unsupported"), F.count_if(bad | half | odd).alias("malformed_or_unsupported"), F.max("ts_us").alias("watermark_us"),
    )
