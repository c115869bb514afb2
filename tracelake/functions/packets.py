"""Packets as people read them: labels, the one-line summary, and the list of layers with their fields.

All of it is Columns over decoded rows, but for names inside DNS and TLS payloads and IPv6 addresses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import dns, tls
from tracelake.functions.decode import DETAILS, FIELDS
from tracelake.functions.formats import flag_text
from tracelake.sources.export import address_text

# Numbers and the labels that outputs show for them. The names of layers and of their fields in
# layers(), and the wording of summaries, are fixed values too.
ETHER_TYPES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "802.1Q VLAN", 0x88A8: "802.1ad VLAN", 0x8847: "MPLS", 0x8848: "MPLS Multicast"}
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 44: "IPv6-Fragment", 58: "ICMPv6"}
ICMP_TYPES = {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"}
ICMPV6_TYPES = {
    1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 4: "Parameter Problem", 128: "Echo Request", 129: "Echo Reply",
    133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation", 136: "Neighbor Advertisement", 137: "Redirect",
}
SLL_PACKET_TYPES = {0: "host", 1: "broadcast", 2: "multicast", 3: "otherhost", 4: "outgoing"}
LOOPBACK_FAMILIES = {2: "AF_INET", 10: "AF_INET6", 24: "AF_INET6", 28: "AF_INET6", 30: "AF_INET6"}
ARP_OPERATIONS = {1: "request", 2: "reply"}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
TAG_KINDS = {0x8100: "802.1Q", 0x88A8: "802.1ad"}

#: What summary() and layers() read of a decoded row.
NEEDED = (*FIELDS, *DETAILS)
LAYER = "struct<name: string, fields: array<struct<field: string, value: string>>>"


def label(number: Column, names: dict[int, str], other: Column) -> Column:
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for k, name in names.items():
        out = out.when(number == k, F.lit(name))
    return out.otherwise(other)


def hex_number(number: Column, digits: int) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number.cast("long"))), digits, "0"))


def ether_type_label(number: Column) -> Column:
    return label(number, ETHER_TYPES, F.concat(F.lit("Unknown("), hex_number(number, 4), F.lit(")")))


def ip_protocol_label(number: Column) -> Column:
    return label(number, IP_PROTOCOLS, F.concat(F.lit("Proto("), number.cast("string"), F.lit(")")))


def icmp_type_label(number: Column, six: Column) -> Column:
    other = F.concat(F.lit("Type("), number.cast("string"), F.lit(")"))
    return F.when(six, label(number, ICMPV6_TYPES, other)).otherwise(label(number, ICMP_TYPES, other))


def octets(data: Column) -> Column:
    """Bytes as 02:00:..., ``-`` for none."""
    pairs = F.regexp_replace(F.lower(F.hex(data)), "(..)(?=.)", "$1:")
    return F.when(F.octet_length(data) == 0, F.lit("-")).otherwise(pairs)


def dotted(data: Column) -> Column:
    """The text of a 4-byte address."""
    part = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10)
    return F.concat_ws(".", part(1), part(2), part(3), part(4))


def address(data: Column) -> Column:
    """The text of an IPv4 or IPv6 address; only the latter leaves the JVM."""
    six = address_text(F.when(F.octet_length(data) == 16, data))
    return F.when(F.octet_length(data) == 4, dotted(data)).otherwise(six)


def _arp_address(data: Column) -> Column:
    return F.when((F.col("arp_protocol") == 0x0800) & (F.octet_length(data) == 4), dotted(data)).otherwise(octets(data))


def arp_text() -> Column:
    sender, target, mac = _arp_address(F.col("arp_sender_ip")), _arp_address(F.col("arp_target_ip")), octets(F.col("arp_sender_mac"))
    other = F.format_string("op(%d) %s -> %s", F.col("arp_operation"), sender, target)
    return F.when(F.col("arp_operation") == 1, F.format_string("who-has %s tell %s (%s)", target, sender, mac)).when(F.col("arp_operation") == 2, F.format_string("%s is-at %s", sender, mac)).otherwise(other)


def icmp_text() -> Column:
    name = icmp_type_label(F.col("icmp_type"), F.col("protocol") == "icmp6")
    return F.when(F.col("icmp_id").isNotNull(), F.format_string("%s id=%d seq=%d", name, F.col("icmp_id"), F.col("icmp_seq"))).otherwise(F.format_string("%s code=%d", name, F.col("icmp_code")))


@F.arrow_udf(returnType=T.StringType())
def first_question(payload: pa.Array) -> pa.Array:
    """Type and name of a message's first question, like ``A www.example.test``; null if it can't be read."""

    def one(message: bytes | None) -> str | None:
        if message is None:
            return None
        try:
            labels, end = dns.labels_at(message, dns.HEADER)
            kind, _ = dns._fields(message, end, "!HH")
        except dns.Malformed:
            return None
        return f"{dns.TYPES.get(kind, f'TYPE{kind}')} {dns.name_text(labels)}"

    return pa.array(map(one, payload.to_pylist()), pa.string())


@F.arrow_udf(returnType=T.StringType())
def server_name(payload: pa.Array) -> pa.Array:
    return pa.array(map(tls.server_name, payload.to_pylist()), pa.string())


def _word(payload: Column, k: int) -> Column:
    return F.conv(F.hex(F.substring(payload, 2 * k + 1, 2)), 16, 10).cast("int")


def with_application(decoded: DataFrame) -> DataFrame:
    """decoded with __dns (the payload, where it has a DNS header) and __sni."""
    ports = (F.col("src_port") == dns.PORT) | (F.col("dst_port") == dns.PORT)
    message = F.when((F.col("protocol") == "udp") & ports & (F.octet_length("payload") >= dns.HEADER), F.col("payload"))
    hello = F.when((F.col("protocol") == "tcp") & (F.hex(F.substring("payload", 1, 2)) == "1603"), F.col("payload"))
    return decoded.withColumns({"__dns": message, "__sni": server_name(hello)})


def dns_text() -> Column:
    d = F.col("__dns")
    flags, asked = _word(d, 1), _word(d, 2)
    rcode = label(flags.bitwiseAND(F.lit(15)), RCODES, F.lit("UNKNOWN"))
    ident = F.concat(F.lit("id="), hex_number(_word(d, 0), 4))
    response = F.concat(ident, F.lit(" R "), rcode, *(x for k, c in enumerate(("Q", "A", "NS", "AR"), 2) for x in (F.lit(f" {c}="), _word(d, k).cast("string"))))
    question = first_question(F.when((flags < 0x8000) & (asked > 0), d))
    query = F.concat(ident, F.lit(" Q "), F.coalesce(question, F.concat(F.lit("QD="), asked.cast("string"))))
    return F.when(flags >= 0x8000, response).otherwise(query)


def summary(decoded: DataFrame) -> DataFrame:
    """decoded (with the fields of NEEDED) with the columns shown_protocol, source, destination and info.
    TLS and DNS go before TCP and UDP; a frame without a network header has its link's label."""
    p, v = F.col("protocol"), F.col("ip_version")
    link = F.when(F.col("loopback_family").isNotNull(), F.concat(F.lit("Loopback "), label(F.col("loopback_family"), LOOPBACK_FAMILIES, F.lit("UNKNOWN"))))
    link = link.when(F.col("ether_type").isNotNull(), ether_type_label(F.col("ether_type"))).when(F.col("parse_error").isNull(), F.lit("IP"))
    ports = {c: F.when(F.col(f"{c}_port").isNotNull(), F.concat(F.lit(":"), F.col(f"{c}_port").cast("string"))).otherwise("") for c in ("src", "dst")}
    ends = {
        c: F.when(v.isNotNull(), F.concat(address(F.col(f"{c}_ip")), ports[c])).when(p == "arp", _arp_address(F.col(a))).otherwise("")
        for c, a in (("src", "arp_sender_ip"), ("dst", "arp_target_ip"))
    }
    out = with_application(decoded)
    tls_, dns_ = F.col("__sni").isNotNull(), F.col("__dns").isNotNull()
    proto = F.when(tls_, "TLS").when(dns_, "DNS").when(p == "tcp", "TCP").when(p == "udp", "UDP").when(p == "icmp", "ICMP").when(p == "icmp6", "ICMPv6").when(p == "arp", "ARP")
    proto = proto.when(v == 4, "IPv4").when(v == 6, "IPv6").otherwise(link)
    tcp = F.format_string("%s seq=%d ack=%d win=%d", flag_text(), F.col("seq"), F.col("ack_no"), F.col("window"))
    info = F.when(tls_, F.concat(F.lit("ClientHello sni="), F.col("__sni"))).when(dns_, dns_text()).when(p == "tcp", tcp)
    info = info.when(p == "udp", F.format_string("len=%d", F.col("udp_length"))).when(p.isin("icmp", "icmp6"), icmp_text()).when(p == "arp", arp_text()).otherwise("")
    return out.withColumns({"shown_protocol": proto, "source": ends["src"], "destination": ends["dst"], "info": info}).drop("__dns", "__sni")


def _layer(name: Column | str, fields: dict[str, Column]) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items())).alias("fields")).cast(LAYER)


def layers(decoded: DataFrame) -> DataFrame:
    """decoded (with link_type and the fields of NEEDED) with ``layers``: name and fields of each, outermost first."""
    c = F.col
    linked, p, v = c("parse_error").isNull(), c("protocol"), c("ip_version")
    kind = F.format_string("%s (%d)", label(c("sll_packet_type"), SLL_PACKET_TYPES, F.lit("unknown")), c("sll_packet_type"))
    size = F.octet_length("sll_address")
    cooked = {"Packet Type": kind, "ARPHRD": c("sll_arphrd"), "Address Length": size}
    ether = ether_type_label(c("ether_type"))
    tags = F.transform(F.arrays_zip("vlans", "vlan_types", "vlan_priorities", "vlan_drop_eligible"), lambda t, i: _layer(
        F.concat(F.when(F.size("vlans") == 1, F.lit("VLAN (")).otherwise(F.concat(F.lit("VLAN Tag "), (i + 1).cast("string"), F.lit(" ("))), label(t["vlan_types"], TAG_KINDS, F.lit("")), F.lit(")")),
        {"VLAN ID": t["vlans"], "Priority": t["vlan_priorities"], "DEI": t["vlan_drop_eligible"] == 1},
    ))
    d = c("__dns")
    flags = _word(d, 1)
    counts = {name: _word(d, k) for k, name in enumerate(("Questions", "Answers", "Authorities", "Additionals"), 2)}
    single = [
        (linked & (c("link_type") == 1), _layer("Ethernet", {"Source": octets(c("eth_src")), "Destination": octets(c("eth_dst")), "EtherType": ether})),
        (linked & (c("link_type") == 113), _layer("Linux SLL", {**cooked, "Protocol": ether})),
        (linked & (c("link_type") == 276), _layer("Linux SLL2", {"Interface Index": c("sll_interface"), **cooked, "Address": octets(c("sll_address")), "Protocol": ether})),
        (linked & c("loopback_family").isNotNull(), _layer("Loopback", {
            "Family": F.format_string("%s (%d)", label(c("loopback_family"), LOOPBACK_FAMILIES, F.lit("UNKNOWN")), c("loopback_family")),
            "Encoding": F.when(c("link_type") == 108, "big-endian").otherwise("native-endian"),
        })),
        (linked & c("link_type").isin(12, 101), _layer("Raw IP", {"Encapsulation": F.lit("None (L3 starts at byte 0)")})),
        (None, tags),
        (c("vlan_truncated"), _layer("VLAN Tags", {"Truncated": F.lit("true (max 4)")})),
        (v == 4, _layer("IPv4", {
            "Source": dotted(c("src_ip")), "Destination": dotted(c("dst_ip")), "Protocol": ip_protocol_label(c("ip_protocol")), "TTL": c("ttl"), "Total Length": c("total_length"), "ID": hex_number(c("ip_id"), 4),
            "Flags": F.concat(F.lit("DF="), c("dont_fragment").cast("string"), F.lit(" MF="), c("more_fragments").cast("string")), "Fragment Offset": c("fragment_offset"),
            "Checksum": F.concat(hex_number(c("ip_checksum"), 4), F.when(c("checksum_ok"), " (valid)").otherwise(" (invalid)")),
        })),
        (v == 6, _layer("IPv6", {
            "Source": address(c("src_ip")), "Destination": address(c("dst_ip")), "Next Header": ip_protocol_label(c("ip_protocol")), "Hop Limit": c("ttl"), "Payload Length": c("payload_length"),
            "Flow Label": hex_number(c("flow_label"), 5),
        })),
        (p == "arp", _layer("ARP", {
            "Hardware Type": F.format_string("%s (%d)", F.when(c("arp_hardware") == 1, "Ethernet").otherwise("Unknown"), c("arp_hardware")),
            "Protocol Type": F.concat(ether_type_label(c("arp_protocol")), F.lit(" ("), hex_number(c("arp_protocol"), 4), F.lit(")")),
            "Address Lengths": F.format_string("hlen=%d plen=%d", F.octet_length("arp_sender_mac"), F.octet_length("arp_sender_ip")),
            "Operation": F.format_string("%s (%d)", label(c("arp_operation"), ARP_OPERATIONS, F.format_string("op(%d)", c("arp_operation"))), c("arp_operation")),
            "Sender Hardware": octets(c("arp_sender_mac")), "Sender Protocol": _arp_address(c("arp_sender_ip")), "Target Hardware": octets(c("arp_target_mac")), "Target Protocol": _arp_address(c("arp_target_ip")),
        })),
        (p == "tcp", _layer("TCP", {
            "Source Port": c("src_port"), "Destination Port": c("dst_port"), "Sequence": c("seq"), "Acknowledgment": c("ack_no"), "Flags": flag_text(), "Window": c("window"),
            "Checksum": hex_number(c("transport_checksum"), 4),
        })),
        (c("__sni").isNotNull(), _layer("TLS", {"Type": F.lit("ClientHello"), "Legacy Version": hex_number(F.conv(F.hex(F.substring("payload", 10, 2)), 16, 10), 4), "SNI": c("__sni")})),
        (p == "udp", _layer("UDP", {"Source Port": c("src_port"), "Destination Port": c("dst_port"), "Length": c("udp_length"), "Checksum": hex_number(c("transport_checksum"), 4)})),
        (d.isNotNull(), _layer("DNS", {
            "ID": hex_number(_word(d, 0), 4), "Message Type": F.when(flags >= 0x8000, "Response").otherwise("Query"), "RCode": label(flags.bitwiseAND(F.lit(15)), RCODES, F.lit("UNKNOWN")), **counts,
            "Question": first_question(F.when(counts["Questions"] > 0, d)),
        })),
        (p.isin("icmp", "icmp6"), _layer(F.when(p == "icmp", "ICMP").otherwise("ICMPv6"), {
            "Type": icmp_type_label(c("icmp_type"), p == "icmp6"), "Code": c("icmp_code"), "Checksum": hex_number(c("transport_checksum"), 4),
            "Identifier": F.when(p == "icmp6", c("icmp_id")), "Sequence": F.when(p == "icmp6", c("icmp_seq")),
        })),
    ]
    found = F.concat(*(part if when is None else F.array(F.when(F.coalesce(when, F.lit(False)), part)) for when, part in ((w, F.coalesce(x, F.array().cast(f"array<{LAYER}>")) if w is None else x) for w, x in single)))
    shown = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(x["name"].alias("name"), F.filter(x["fields"], lambda f: f["value"].isNotNull()).alias("fields")))
    return with_application(decoded).withColumn("layers", shown).drop("__dns", "__sni")
