"""Headers as bytes, from packet rows: Ethernet, IPv4 with checksum, TCP or UDP, all in Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Addresses and type of the Ethernet header that every frame gets.
ETHERNET = "0200000000010200000000020800"


def number(value: Column | int, size: int) -> Column:
    """value as ``size`` big-endian bytes."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def encode(packets: DataFrame) -> DataFrame:
    """packets (32-bit addresses; syn, ack, seq, ack_no) with link_type and raw: the headers only, as a
    capture with a short snap length has them. The declared length is that of wire_len."""
    total = F.least(F.col("wire_len") - 14, F.lit(65535))
    tcp = F.col("protocol") == "tcp"
    proto, ident = F.when(tcp, 6).otherwise(17), F.col("frame_no") % 65536
    high, low = lambda c: F.floor(F.col(c) / 65536), lambda c: F.col(c) % 65536
    words = F.lit(0x4500) + total + ident + F.lit(64 * 256) + proto + high("src_ip") + low("src_ip") + high("dst_ip") + low("dst_ip")
    once = words % 65536 + F.floor(words / 65536)
    checksum = 65535 - (once % 65536 + F.floor(once / 65536))
    network = [number(0x4500, 2), number(total, 2), number(ident, 2), number(0, 2), number(64, 1), number(proto, 1), number(checksum, 2), number(F.col("src_ip"), 4), number(F.col("dst_ip"), 4)]
    ports = [number(F.col("src_port"), 2), number(F.col("dst_port"), 2)]
    flags = F.when(F.col("syn"), 2).otherwise(0) + F.when(F.col("ack"), 16).otherwise(0)
    segment = F.concat(number(F.col("seq"), 4), number(F.col("ack_no"), 4), number(0x50, 1), number(flags, 1), number(65535, 2), number(0, 4))
    datagram = F.concat(number(total - 20, 2), number(0, 2))
    raw = F.concat(F.unhex(F.lit(ETHERNET)), *network, *ports, F.when(tcp, segment).otherwise(datagram))
    return packets.withColumns({"link_type": F.lit(1), "raw": raw})
