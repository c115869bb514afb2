"""Flow records as JSON or CSV rows, written as folders of part files, one writer a partition.

Times are seconds. CSV has a fixed number of decimals and blanks for nulls; JSON keeps nulls.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.flows import KEY

# The columns, in order, and their decimals.
CSV_COLUMNS = (
    "protocol", "endpoint_a_ip", "endpoint_a_port", "endpoint_b_ip", "endpoint_b_port", "first_seen", "last_seen", "duration_secs", "packets_a_to_b", "packets_b_to_a",
    "bytes_a_to_b", "bytes_b_to_a", "packets_total", "bytes_total", "avg_bps", "tcp_state", "client", "retransmissions", "out_of_order", "rtt_last_ms", "rtt_min_ms",
    "rtt_ewma_ms", "rtt_samples", "tls_sni", "dns_queries", "dns_matched_responses", "dns_unanswered_queries", "dns_tracking_limit_hits", "dns_nxdomain", "dns_servfail",
    "dns_response_latency_min_ms", "dns_response_latency_avg_ms", "dns_response_latency_max_ms",
)
DECIMALS = {"ts": 6, "first_seen": 6, "last_seen": 6, "duration_secs": 6, "avg_bps": 3, **{c: 3 for c in CSV_COLUMNS if c.endswith("_ms")}}


def address_text(address: Column) -> Column:
    """The usual text of a 4- or 16-byte address, null for any other."""

    @F.arrow_udf(returnType="string")
    def text(packed: pa.Array) -> pa.Array:
        return pa.array([str(ipaddress.ip_address(x)) if x is not None and len(x) in (4, 16) else None for x in packed.to_pylist()], pa.string())

    return text(address)


def records(flows: DataFrame) -> DataFrame:
    """Snapshots with the columns of CSV_COLUMNS; where they expired, ts and reason come first."""
    seconds = {"first_seen": F.col("first_us") / 1e6, "last_seen": F.col("last_us") / 1e6}
    ends = {f"endpoint_{s}_{what}": c for s in "ab" for what, c in (("ip", address_text(F.col(f"{s}_ip"))), ("port", F.col(f"{s}_port")))}
    out = flows.withColumns({**seconds, **ends})
    if "expired_us" not in flows.columns:
        return out.select(*CSV_COLUMNS)
    reason = F.col("reason") if "reason" in flows.columns else F.lit("timeout").alias("reason")
    return out.select((F.col("expired_us") / 1e6).alias("ts"), reason, *CSV_COLUMNS)


def csv_rows(flows: DataFrame) -> DataFrame:
    rows = records(flows)
    fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{DECIMALS[c]}f", F.col(c)))
    return rows.select(*(fixed(c).alias(c) if c in DECIMALS else F.col(c) for c in rows.columns))


def json_rows(flows: DataFrame) -> DataFrame:
    """Endpoints and DNS statistics are objects; flows without statistics have a null one."""
    rows = records(flows)
    end = lambda s: F.struct(F.col(f"endpoint_{s}_ip").alias("ip"), F.col(f"endpoint_{s}_port").alias("port")).alias(f"endpoint_{s}")
    dns = [c for c in CSV_COLUMNS if c.startswith("dns_")]
    plain = [c for c in CSV_COLUMNS if not c.startswith(("dns_", "endpoint_", "tls_")) and c != "protocol"]
    stats = F.when(F.col("dns_queries").isNotNull(), F.struct(*(F.col(c).alias(c.removeprefix("dns_")) for c in dns))).alias("dns")
    first = [c for c in ("ts", "reason") if c in rows.columns]
    return rows.select(*first, "protocol", end("a"), end("b"), *plain, stats, "tls_sni")


def write_csv(flows: DataFrame, path: str) -> None:
    csv_rows(flows).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(flows: DataFrame, path: str) -> None:
    """One object a line."""
    json_rows(flows).write.option("ignoreNullFields", False).json(path)


def write_json_array(flows: DataFrame, path: str) -> None:
    """One JSON document: the part files, one after another in the order of their names, are an array of the objects of
    json_rows, the largest flows first. Only the first object has no comma before it; which it is, a top-1 tells. Flows
    are told apart by key and instance."""
    own = [c for c in (*KEY, "instance") if c in flows.columns]
    at = F.struct((-F.col("bytes_total")).alias("size"), *own)
    first = flows.select(at.alias("at")).orderBy("at").first()  # one row
    leads = at == F.struct(*(F.lit(bytearray(x) if isinstance(x, bytes) else x).cast(f.dataType).alias(f.name) for x, f in zip(first.at, flows.select(at.alias("at")).schema["at"].dataType.fields))) if first else F.lit(False)
    # The place and the mark travel through json_rows in the last column.
    rows = json_rows(flows.withColumn("tls_sni", F.struct("tls_sni", at.alias("at"), leads.alias("leads"))))
    plain = [c for c in rows.columns if c != "tls_sni"]
    text = F.to_json(F.struct(*plain, F.col("tls_sni.tls_sni").alias("tls_sni")), {"ignoreNullFields": "false"})
    objects = rows.select(F.lit(1).alias("part"), F.col("tls_sni.at").alias("at"), F.concat(F.when(F.col("tls_sni.leads"), "").otherwise(","), text).alias("value"))
    edges = flows.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, value string").withColumn("at", F.lit(None).cast(objects.schema["at"].dataType))
    edges.select("part", "at", "value").unionByName(objects).orderBy("part", "at").select("value").write.text(path)
