"""Whole flow records: volumes, TCP state, DNS statistics and the first server name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import dns as dns_messages
from tracelake.functions import tls
from tracelake.operators import dns, flows, tcp

#: Decoded fields that a snapshot needs.
FIELDS = ("protocol", "src_ip", "dst_ip", "src_port", "dst_port", "syn", "ack", "fin", "rst", "seq", "ack_no", "seq_len", "payload", "udp_whole")
_COUNTS = ("retransmissions", "out_of_order", "rtt_samples")


def snapshots(packets: DataFrame, *more_keys: str) -> DataFrame:
    """One row a flow, or a flow's life with "instance" as a further key. packets: keyed, decoded rows with
    frame_no, ts_us, watermark_us, wire_len. UDP flows have no TCP state and zero TCP counts, flows without
    a query no DNS statistics. All parts are grouped by the same key, so their joins need no further shuffle
    beyond those of the groups."""
    key = [*flows.KEY, *more_keys]
    asked = dns_messages.messages(packets.filter("udp_whole"), details=False)
    named = tls.server_names(packets).filter("tls_sni is not null").groupBy(*key).agg(F.min_by("tls_sni", "frame_no").alias("tls_sni"))
    out = flows.aggregate(packets, *more_keys)
    for part in (tcp.tcp_flows(packets, *more_keys), dns.dns_flows(asked, *more_keys), named):
        out = out.join(part, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in _COUNTS})
