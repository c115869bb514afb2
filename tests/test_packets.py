"""Captures built byte by byte: files, decoding, accounting, TCP state."""

import hashlib
import ipaddress
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.functions import decode
from tracelake.operators import accounting, flows, tcp
from tracelake.sources import captures, pcap

MACS = bytes.fromhex("020000000001020000000002")
START = 1_700_000_000_000_000


def checksum(data: bytes) -> int:
    total = sum(struct.unpack(f"!{(len(data) + 1) // 2}H", data + b"\0" * (len(data) % 2)))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def ip(src, dst, proto, body, ident=0):
    a, b = ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed
    if len(a) == 16:
        return struct.pack("!IHBB", 6 << 28, len(body), proto, 64) + a + b + body
    head = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), ident, 0, 64, proto, 0) + a + b
    return head[:10] + struct.pack("!H", checksum(head)) + head[12:] + body


def pseudo(src, dst, proto, body):
    a, b = ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed
    return a + b + (struct.pack("!II", len(body), proto) if len(a) == 16 else struct.pack("!HH", proto, len(body))) + body


def segment(src, sport, dst, dport, flags, seq, ack=0, body=b""):
    make = lambda c: struct.pack("!HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 65535, c, 0) + body
    return make(checksum(pseudo(src, dst, 6, make(0))))


def datagram(src, sport, dst, dport, body):
    make = lambda c: struct.pack("!HHHH", sport, dport, 8 + len(body), c) + body
    return make(checksum(pseudo(src, dst, 17, make(0))) or 0xFFFF)


def ether(kind, body, vlans=()):
    tags = b"".join(struct.pack("!HH", t, v) for t, v in vlans)
    return MACS + tags + struct.pack("!H", kind) + body


def echo(src, dst, kind, number, seq, body, over=b""):
    make = lambda c: struct.pack("!BBHHH", kind, 0, c, number, seq) + body
    return make(checksum(pseudo(src, dst, 58, make(0)) if over else make(0)))


def cooked(frame, interface, kind):
    return frame[12:14] + struct.pack("!HIHBB", 0, interface, 1, kind, 6) + MACS[6:] + b"\0\0" + frame[14:]


def tcp4(src, sport, dst, dport, flags, seq, ack=0, ident=0):
    return ether(0x0800, ip(src, dst, 6, segment(src, sport, dst, dport, flags, seq, ack), ident))


QINQ = ((0x88A8, 100), (0x8100, 200))


def port_scan():
    ports = (21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 993, 995, 1433, 3306, 5432, 8080)
    return [tcp4("192.0.2.50", 45000, "198.51.100.20", p, 2, 1000 + i, ident=i) for i, p in enumerate(ports, 1)]


def syn_flood():
    return [tcp4(f"198.18.{i // 254}.{i % 254 + 1}", 30000 + i, "203.0.113.200", 443, 2, 10000 + i, ident=i + 1) for i in range(64)]


def protocol_edges():
    """Frames of our own, one of each kind that decoding treats apart."""
    six, near = ("fd00:7::a", "fd00:7::b"), ("fd00:9::1", "fd00:9::2")
    tagged = ip("10.20.30.40", "10.20.30.41", 17, datagram("10.20.30.40", 6000, "10.20.30.41", 6001, b"in two tags"), 7)
    return [
        ether(0x86DD, ip(*six, 6, segment(six[0], 40100, six[1], 8443, 2, 77))), ether(0x0800, tagged, QINQ),
        ether(0x0800, ip("10.9.8.7", "10.9.8.6", 1, echo(None, None, 8, 0x0BAD, 5, b"are you there"), 12)),
        ether(0x86DD, ip(*near, 58, echo(*near, 128, 0x0C0D, 6, b"and you", over=b"6"))),
        ether(0x0800, ip("10.0.5.1", "10.0.5.2", 6, bytes(range(9)), 99)), ether(0x88CC, b"no protocol that is known"),
    ]


def linux_sll2():
    out = []
    for r in (0, 1):
        (a, p), (b, q) = [("192.0.2.10", 53000), ("198.51.100.20", 443)][:: 1 - 2 * r]
        out.append(cooked(tcp4(a, p, b, q, 0x12 if r else 2, 1, 2 * r, 40 + r), 0x01020304 + r, 4 - 4 * r))
    for r in (0, 1):
        (a, p), (b, q) = [("2001:db8::10", 54000), ("2001:db8::20", 9000)][:: 1 - 2 * r]
        out.append(cooked(ether(0x86DD, ip(a, b, 0, bytes([17, 0, 0, 0, 0, 0, 0, 0]) + datagram(a, p, b, q, b"sll2-ipv6"))), 7 + r, 4 - 4 * r))
    for r in (0, 1):
        (a, p), (b, q) = [("192.0.2.30", 55000), ("198.51.100.40", 9001)][:: 1 - 2 * r]
        out.append(cooked(ether(0x0800, ip(a, b, 17, datagram(a, p, b, q, b"sll2-qinq"), 42 + r), QINQ), 9 + r, 4 - 4 * r))
    arp = struct.pack("!HHBBH", 1, 0x0800, 6, 4, 1) + MACS[6:] + ipaddress.ip_address("192.0.2.10").packed + bytes(6) + ipaddress.ip_address("192.0.2.1").packed
    return [*out, cooked(ether(0x0806, arp), 2, 1), cooked(ether(0x88B5, b"sll2-unsupported"), 3, 2)]


#: The frames of port_scan, syn_flood and linux_sll2 and the table below are fixed values: the digests need them.
#: Link type, interval in microseconds, SHA-256 prefix and suffix of the file, and the counts
#: with_network, with_transport, parse_errors, transport_errors, unsupported, malformed_or_unsupported.
GOLDEN = {
    "port_scan": (port_scan, 1, 100_000, "ff21d31c", "85db", (16, 16, 0, 0, 0, 0)),
    "syn_flood": (syn_flood, 1, 50_000, "3c08061a", "60b4", (64, 64, 0, 0, 0, 0)),
    "protocol_edges": (protocol_edges, 1, 250_000, None, None, (5, 4, 0, 1, 1, 2)),
    "linux_sll2": (linux_sll2, 276, 100_000, "62b26724", "4c94", (7, 6, 0, 0, 1, 1)),
}


def frames_of(spark, packets, every):
    rows = [(i + 1, START + i * every, len(p), bytearray(p)) for i, p in enumerate(packets)]
    return spark.createDataFrame(rows, "frame_no long, ts_us long, wire_len long, raw binary")


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_capture(spark, tmp_path, name):
    make, link, every, first, last, counts = GOLDEN[name]
    pcap.write_pcap(frames_of(spark, make(), every), str(tmp_path / "out"), link_type=link, files=1)
    (file,) = (tmp_path / "out").glob("*.pcap")
    digest = hashlib.sha256(file.read_bytes()).hexdigest()
    assert first is None or (digest[:8], digest[-4:]) == (first, last)  # None: a payload of our own
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    frames = pcap.read_pcap(spark, str(file))
    got = accounting.account(decode.decode(frames)).first()
    assert (got.with_network, got.with_transport, got.parse_errors, got.transport_errors, got.unsupported, got.malformed_or_unsupported) == counts
    assert got.frames_read == len(make()) and got.wire_bytes == sum(map(len, make()))


def test_rotation_keeps_order(spark, tmp_path):
    pcap.write_pcap(frames_of(spark, syn_flood(), 1), str(tmp_path / "out"), rotate_bytes=300, files=2)
    files = sorted((tmp_path / "out").glob("*.pcap"))
    assert len(files) > 4 and all(f.stat().st_size < 300 + 70 for f in files)
    back = pcap.read_pcap(spark, str(tmp_path / "out")).orderBy("frame_no").collect()
    assert [r.frame_no for r in back] == list(range(1, 65)) and [bytes(r.raw) for r in back] == syn_flood()


def test_bad_captures():
    for content in (b"", b"x" * 30, struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"abc"):
        with pytest.raises(ValueError):
            list(captures.whole("x", memoryview(content)))
    big = struct.pack(">IHHiIIIIIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1, 5, 7000, 0, 9)
    (batch,) = captures.whole("x", memoryview(big))
    assert batch.select(["ts_sec", "ts_usec", "wire_len", "link_type", "raw"]).to_pylist() == [{"ts_sec": 5, "ts_usec": 7, "wire_len": 9, "link_type": 1, "raw": b""}]


def test_decoded_fields(spark):
    frames = frames_of(spark, protocol_edges(), 1).withColumn("link_type", F.lit(1)).withColumn("ttl", F.lit("clash"))
    rows = decode.decode(frames).orderBy("frame_no").collect()
    assert [r.protocol for r in rows] == ["tcp", "udp", "icmp", "icmp6", None, None]
    assert rows[1].vlans == [100, 200] and bytes(rows[1].payload) == b"in two tags" and rows[1].checksum_ok
    assert bytes(rows[0].src_ip) == ipaddress.ip_address("fd00:7::a").packed and rows[0].seq_len == 1 and rows[0].ttl == 64
    assert rows[4].transport_error and rows[5].unsupported and rows[5].ip_version is None


def test_any_bytes_decode():
    r = random.Random(5)
    base = protocol_edges() + port_scan()[:1]
    raw = [None, b""] + [bytes(r.randrange(256) if r.random() < 0.05 else c for c in p[: r.randint(0, len(p))]) for p in base for _ in range(300)]
    import numpy as np

    for link in (0, 1, 12, 101, 108, 113, 276, 999):
        found = decode.decode_batch(pa.array(raw, pa.binary()), np.full(len(raw), link))
        assert set(found) == set(decode.FIELDS) and all(len(c) == len(raw) for c in found.values())
        more = tuple(decode.DETAILS)
        found = decode.decode_batch(pa.array(raw, pa.binary()), np.full(len(raw), link), more)
        alone = [decode.decode_batch(pa.array([x], pa.binary()), np.array([link]), more) for x in raw[::37]]
        for name, column in found.items():
            assert column.to_pylist()[::37] == [a[name].to_pylist()[0] for a in alone], name


def test_tcp_flow(spark):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
    steps = [(a, b, 2, 100, 0, b""), (b, a, 18, 500, 101, b""), (a, b, 16, 101, 501, b""), (a, b, 24, 101, 501, b"hello"), (b, a, 16, 501, 106, b""), (a, b, 24, 101, 501, b"hello"), (a, b, 24, 120, 501, b"x"), (a, b, 24, 110, 501, b"y"), (a, b, 17, 121, 501, b""), (b, a, 17, 501, 122, b"")]
    packets = [ether(0x0800, ip(s[0], d[0], 6, segment(*s, *d, f, q, k, body))) for s, d, f, q, k, body in steps]
    frames = frames_of(spark, packets, 10_000).withColumn("link_type", F.lit(1))
    keyed = flows.with_key(flows.eligible(decode.decode(frames)))
    row = tcp.tcp_flows(keyed).first()
    assert (row.tcp_state, row.client, row.retransmissions, row.out_of_order, row.rtt_samples) == ("closed", "a_to_b", 1, 1, 5)
    assert (row.rtt_last_ms, row.rtt_min_ms) == (10.0, 10.0)
    assert tcp.tcp_flows(keyed.limit(0)).count() == 0
