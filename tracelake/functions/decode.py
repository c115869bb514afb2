"""Header decoding: frames to packet rows, whole Arrow batches at a time.

Every field of a batch is gathered by one numpy index over the batch's bytes; only VLAN tags and IPv6
extension headers need passes, one for each level of the deepest frame. Bad bytes are data: a frame
that can't be decoded has ``parse_error``, a bad transport header ``transport_error``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Fixed values of the formats.
ETHERNET, SLL, SLL2, NULL, LOOP, RAW = 1, 113, 276, 0, 108, (12, 101)
LINK_HEADER = {ETHERNET: 14, SLL: 16, SLL2: 20, NULL: 4, LOOP: 4, 12: 0, 101: 0}
ETHER_TYPE_AT = {ETHERNET: 12, SLL: 14, SLL2: 0}
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
VLAN_TAGS = (0x8100, 0x88A8)
ICMP, TCP, UDP, FRAGMENT, AUTHENTICATION, ICMPV6 = 1, 6, 17, 44, 51, 58
OPTION_HEADERS = (0, 43, 60, 135, 139, 140)
TRANSPORT = {ICMP: ("icmp", 8), TCP: ("tcp", 20), UDP: ("udp", 8), ICMPV6: ("icmp6", 8)}
TCP_FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg")
VLANS_KEPT, EXTENSIONS = 4, 16

FIELDS = {
    "parse_error": "string", "transport_error": "string", "unsupported": "boolean", "ether_type": "int", "vlans": "array<int>", "vlan_truncated": "boolean",
    "ip_version": "int", "protocol": "string", "ip_protocol": "int", "src_ip": "binary", "dst_ip": "binary", "ttl": "int", "checksum_ok": "boolean", "fragment": "boolean",
    "src_port": "long", "dst_port": "long", **{f: "boolean" for f in TCP_FLAGS}, "seq": "long", "ack_no": "long", "window": "int", "seq_len": "long", "payload": "binary",
    "udp_whole": "boolean",
}
#: Fields that only details of packets need; they are computed where they are asked for.
DETAILS = {
    "eth_src": "binary", "eth_dst": "binary", "vlan_types": "array<int>", "vlan_priorities": "array<int>", "vlan_drop_eligible": "array<int>",
    "sll_packet_type": "int", "sll_arphrd": "int", "sll_address": "binary", "sll_interface": "long", "loopback_family": "long",
    "header_length": "int", "dscp": "int", "ecn": "int", "total_length": "int", "ip_id": "int", "dont_fragment": "boolean", "more_fragments": "boolean", "fragment_offset": "int",
    "ip_checksum": "int", "traffic_class": "int", "flow_label": "int", "payload_length": "int",
    "arp_hardware": "int", "arp_protocol": "int", "arp_operation": "int", "arp_sender_mac": "binary", "arp_sender_ip": "binary", "arp_target_mac": "binary", "arp_target_ip": "binary",
    "data_offset": "int", "transport_checksum": "int", "urgent_pointer": "int", "tcp_options": "binary", "udp_length": "int",
    "icmp_type": "int", "icmp_code": "int", "icmp_id": "int", "icmp_seq": "int",
}
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


class _Bytes:
    """Big-endian reads at one position a frame; reads past a frame's end give rubbish that callers mask."""

    def __init__(self, raw: pa.Array):
        raw = raw.cast(pa.large_binary()).fill_null(b"")
        n, buffers = len(raw), raw.buffers()
        edges = np.frombuffer(buffers[1], np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(1, np.uint8)
        self.start, self.size = edges[:-1], np.diff(edges)

    def u8(self, at) -> np.ndarray:
        return self.data[np.minimum(self.start + at, len(self.data) - 1)].astype(np.int64)

    def u16(self, at) -> np.ndarray:
        return self.u8(at) << 8 | self.u8(at + 1)

    def u32(self, at) -> np.ndarray:
        return self.u16(at) << 16 | self.u16(at + 2)

    def slices(self, at: np.ndarray, end: np.ndarray, where: np.ndarray) -> pa.Array:
        """Bytes [at, end) of the frames of where, null elsewhere."""
        length = np.where(where, np.maximum(end - at, 0), 0)
        edges = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(edges[-1]) + np.repeat(self.start + at - edges[:-1], length)
        packed = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(self.data[index].tobytes())])
        return pc.if_else(pa.array(where), packed, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _ipv4_sums(b: _Bytes, pos: np.ndarray, header: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Whether the header's one's-complement sum is right."""
    total = np.zeros(len(pos), np.int64)
    for k in range(0, int(header[where].max(initial=0)), 2):
        total += np.where(where & (k < header), b.u16(pos + k), 0)
    total = (total & 0xFFFF) + (total >> 16)
    return ((total & 0xFFFF) + (total >> 16)) == 0xFFFF


def decode_batch(raw: pa.Array, link: np.ndarray, details: tuple[str, ...] = ()) -> dict[str, pa.Array]:
    """The columns of FIELDS, and of ``details``, for frames ``raw`` of link types ``link``."""
    b, n = _Bytes(raw), len(raw)
    false = np.zeros(n, bool)
    errors = np.full(n, None, object)
    ok = np.ones(n, bool)

    def fail(where: np.ndarray, message: str) -> None:
        where = where & ok
        errors[where] = message
        ok[where] = False

    known = np.isin(link, list(LINK_HEADER))
    fail(~known, "unsupported link type")
    pos, ether = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for kind, size in LINK_HEADER.items():
        here = link == kind
        if here.any():
            fail(here & (b.size < size), "link header too short")
            pos[here] = size
            if kind in ETHER_TYPE_AT:
                ether = np.where(here, b.u16(np.full(n, ETHER_TYPE_AT[kind])), ether)
    typed = ether >= 0
    depth, tags, kinds = np.zeros(n, np.int64), np.full((n, VLANS_KEPT), -1, np.int32), np.full((n, VLANS_KEPT), -1, np.int32)
    while (tagged := ok & np.isin(ether, VLAN_TAGS)).any():
        fail(tagged & (b.size - pos < 4), "VLAN tag too short")
        tagged &= ok
        kept = np.flatnonzero(tagged & (depth < VLANS_KEPT))
        tags[kept, depth[kept]], kinds[kept, depth[kept]] = b.u16(pos)[kept], ether[kept]
        ether = np.where(tagged, b.u16(pos + 2), ether)
        pos, depth = pos + 4 * tagged, depth + tagged
    left = b.size - pos
    nibble = b.u8(pos) >> 4
    fail(~typed & (left < 1), "IP packet empty")
    v4 = ok & np.where(typed, ether == IPV4, nibble == 4)
    v6 = ok & np.where(typed, ether == IPV6, nibble == 6)
    arp = ok & typed & (ether == ARP)
    unsupported = ok & ~(v4 | v6 | arp)

    ihl = (b.u8(pos) & 15) * 4
    fail(v4 & (left < 20), "IPv4 header too short")
    fail(v4 & (nibble != 4), "IPv4 version")
    fail(v4 & (ihl < 20), "IPv4 header length")
    fail(v4 & (left < ihl), "IPv4 header too short")
    fail(v6 & (left < 40), "IPv6 header too short")
    fail(v6 & (nibble != 6), "IPv6 version")
    fail(arp & (left < 8), "ARP header too short")
    fail(arp & (left < 8 + 2 * (b.u8(pos + 4) + b.u8(pos + 5))), "ARP addresses too short")
    v4, v6, arp = v4 & ok, v6 & ok, arp & ok
    declared = b.u16(pos + 2)
    proto = np.where(v4, b.u8(pos + 9), np.where(v6, b.u8(pos + 6), -1))
    later = v4 & ((b.u16(pos + 6) & 0x1FFF) != 0)
    l4 = np.where(v4, pos + ihl, np.where(v6, pos + 40, pos))
    end = np.where(v4, np.minimum(pos + np.maximum(declared, ihl), b.size), np.where(v6, np.minimum(pos + 40 + b.u16(pos + 4), b.size), b.size))
    walking = v6.copy()
    for _ in range(EXTENSIONS):
        walking &= l4 < end
        options, fragment, auth = np.isin(proto, OPTION_HEADERS), proto == FRAGMENT, proto == AUTHENTICATION
        count = b.u8(l4 + 1)
        size = np.where(options, (count + 1) * 8, np.where(auth, (count + 2) * 4, 8))
        walking &= (options | fragment | auth) & (l4 + np.where(fragment, 8, 2) <= end) & (l4 + size <= end)
        if not walking.any():
            break
        cut = walking & fragment & ((b.u16(l4 + 2) >> 3) != 0)
        proto = np.where(walking & ~cut, b.u8(l4), proto)
        later |= cut
        l4 = l4 + np.where(walking, size, 0)
        walking &= ~cut

    network = v4 | v6
    unsupported |= later | (network & ~np.isin(proto, list(TRANSPORT)))
    bad, names, header = np.full(n, None, object), np.full(n, None, object), np.zeros(n, np.int64)
    room = end - l4
    for number, (name, least) in TRANSPORT.items():
        here = network & ~later & (proto == number)
        size = (b.u8(l4 + 12) >> 4) * 4 if number == TCP else np.full(n, least)
        short, low = here & (room < least), here & (room >= least) & (size < least)
        bad[short | (here & ~low & (room < size))], bad[low] = f"{name} header too short", f"{name} data offset"
        good = here & (bad == None)  # noqa: E711
        names[good], header[good] = name, size[good]
    tcp, udp = names == "tcp", names == "udp"
    ports = tcp | udp
    flags = b.u8(l4 + 13)
    body = l4 + header
    stop = np.where(udp, np.minimum(end, l4 + np.maximum(b.u16(l4 + 4), 8)), end)
    # The declared length counts for IPv4, the captured one for IPv6 and where the declared one is too small.
    claimed = declared - ihl - header
    carried = np.where(v4 & (claimed >= 0), claimed, np.maximum(end - body, 0))
    seq_len = carried + (flags >> 1 & 1) + (flags & 1)

    def ints(values, where, kind=pa.int32()):
        return pa.array(values, kind, mask=~where)

    kept = np.minimum(depth, VLANS_KEPT)


    def per_tag(values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(values[np.arange(VLANS_KEPT) < kept[:, None]], pa.int32()))

    zero, echo = np.zeros(n, np.int64), ((names == "icmp") & np.isin(b.u8(l4), (0, 8))) | ((names == "icmp6") & np.isin(b.u8(l4), (128, 129)))
    icmp, cooked, cooked2, loop = (names == "icmp") | (names == "icmp6"), ok & (link == SLL), ok & (link == SLL2), ok & np.isin(link, (NULL, LOOP))
    hlen, plen, at = b.u8(pos + 4), b.u8(pos + 5), pos + 8
    told = b.u16(pos + 6)
    swapped = b.u8(3) << 24 | b.u8(2) << 16 | b.u8(1) << 8 | b.u8(0)
    address = np.where(cooked, 6, 12)
    late = {
        "eth_src": lambda: b.slices(zero + 6, zero + 12, ok & (link == ETHERNET)), "eth_dst": lambda: b.slices(zero, zero + 6, ok & (link == ETHERNET)),
        "vlan_types": lambda: per_tag(kinds), "vlan_priorities": lambda: per_tag(tags >> 13), "vlan_drop_eligible": lambda: per_tag(tags >> 12 & 1),
        "sll_packet_type": lambda: ints(np.where(cooked, b.u16(zero), b.u8(zero + 10)), cooked | cooked2), "sll_arphrd": lambda: ints(np.where(cooked, b.u16(zero + 2), b.u16(zero + 8)), cooked | cooked2),
        "sll_address": lambda: b.slices(address, address + np.minimum(np.where(cooked, b.u16(zero + 4), b.u8(zero + 11)), 8), cooked | cooked2),
        "sll_interface": lambda: ints(b.u32(zero + 4), cooked2, pa.int64()), "loopback_family": lambda: ints(np.where(link == LOOP, b.u32(zero), swapped), loop, pa.int64()),
        "header_length": lambda: ints(ihl, v4), "dscp": lambda: ints(b.u8(pos + 1) >> 2, v4), "ecn": lambda: ints(b.u8(pos + 1) & 3, v4), "total_length": lambda: ints(declared, v4),
        "ip_id": lambda: ints(b.u16(pos + 4), v4), "dont_fragment": lambda: pa.array((told >> 14 & 1).astype(bool), mask=~v4), "more_fragments": lambda: pa.array((told >> 13 & 1).astype(bool), mask=~v4),
        "fragment_offset": lambda: ints(told & 0x1FFF, v4), "ip_checksum": lambda: ints(b.u16(pos + 10), v4),
        "traffic_class": lambda: ints(b.u16(pos) >> 4 & 0xFF, v6), "flow_label": lambda: ints(b.u32(pos) & 0xFFFFF, v6), "payload_length": lambda: ints(b.u16(pos + 4), v6),
        "arp_hardware": lambda: ints(b.u16(pos), arp), "arp_protocol": lambda: ints(b.u16(pos + 2), arp), "arp_operation": lambda: ints(told, arp),
        "arp_sender_mac": lambda: b.slices(at, at + hlen, arp), "arp_sender_ip": lambda: b.slices(at + hlen, at + hlen + plen, arp),
        "arp_target_mac": lambda: b.slices(at + hlen + plen, at + 2 * hlen + plen, arp), "arp_target_ip": lambda: b.slices(at + 2 * hlen + plen, at + 2 * (hlen + plen), arp),
        "data_offset": lambda: ints(header // 4, tcp), "transport_checksum": lambda: ints(b.u16(l4 + np.where(tcp, 16, np.where(udp, 6, 2))), ports | icmp),
        "urgent_pointer": lambda: ints(b.u16(l4 + 18), tcp), "tcp_options": lambda: b.slices(l4 + 20, body, tcp), "udp_length": lambda: ints(b.u16(l4 + 4), udp),
        "icmp_type": lambda: ints(b.u8(l4), icmp), "icmp_code": lambda: ints(b.u8(l4 + 1), icmp), "icmp_id": lambda: ints(b.u16(l4 + 4), echo), "icmp_seq": lambda: ints(b.u16(l4 + 6), echo),
    }
    return {f: late[f]() for f in details} | {
        "parse_error": pa.array(errors, pa.string()), "transport_error": pa.array(bad, pa.string()), "unsupported": pa.array(unsupported & ok), "ether_type": ints(ether, typed & ok),
        "vlans": per_tag(tags & 0xFFF), "vlan_truncated": pa.array(depth > VLANS_KEPT), "ip_version": ints(np.where(v4, 4, 6), network), "protocol": pa.array(np.where(arp, "arp", names), pa.string()),
        "ip_protocol": ints(proto, network),
        "src_ip": b.slices(pos + np.where(v4, 12, 8), pos + np.where(v4, 16, 24), network), "dst_ip": b.slices(pos + np.where(v4, 16, 24), pos + np.where(v4, 20, 40), network),
        "ttl": ints(np.where(v4, b.u8(pos + 8), b.u8(pos + 7)), network), "checksum_ok": pa.array(_ipv4_sums(b, pos, ihl, v4), mask=~v4), "fragment": pa.array(later, mask=~network),
        "src_port": ints(b.u16(l4), ports, pa.int64()), "dst_port": ints(b.u16(l4 + 2), ports, pa.int64()),
        **{f: pa.array(np.where(tcp, (flags >> k & 1).astype(bool), false)) for k, f in enumerate(TCP_FLAGS)},
        "seq": ints(b.u32(l4 + 4), tcp, pa.int64()), "ack_no": ints(b.u32(l4 + 8), tcp, pa.int64()), "window": ints(b.u16(l4 + 14), tcp), "seq_len": ints(seq_len, tcp, pa.int64()),
        "payload": b.slices(np.where(names != None, body, l4), stop, ok),  # noqa: E711
        # Whether the datagram is as long as its header says.
        "udp_whole": pa.array(b.u16(l4 + 4) == 8 + np.maximum(stop - body, 0), mask=~udp),
    }


def decode(frames: DataFrame, *fields: str) -> DataFrame:
    """frames (raw, link_type and any other columns) with the decoded ``fields``, all for none, instead of
    raw; fields of DETAILS only if they are named. Columns of frames that clash with decoded ones are replaced."""
    wanted = fields or tuple(FIELDS)
    kinds = {**FIELDS, **DETAILS}
    details = tuple(f for f in wanted if f in DETAILS)
    kept = [c for c in frames.columns if c != "raw" and c not in wanted]
    schema = ", ".join([*(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept), *(f"{f} {kinds[f]}" for f in wanted)])

    def run(batches):
        for batch in batches:
            link = np.asarray(batch.column("link_type").fill_null(-1))
            found = decode_batch(batch.column("raw"), link, details)
            columns = [*(batch.column(c) for c in kept), *(found[f].cast(_ARROW[kinds[f]]) for f in wanted)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *wanted])

    return frames.mapInArrow(run, schema)
