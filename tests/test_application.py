"""DNS and TLS payloads built byte by byte, their statistics, and flow records as files."""

import csv
import json
import random
import struct

import pytest

from tests.test_packets import datagram, ether, frames_of, ip, segment
from tracelake.functions import dns, tls
from tracelake.functions.decode import decode
from tracelake.operators import flows, snapshots
from tracelake.operators.dns import Flow
from tracelake.sources import export
from pyspark.sql import functions as F

NAME = b"\x03www\x07Example\x04test\0"


def message(ident=7, flags=0x0100, name=NAME, counts=(1, 0, 0, 0), more=b""):
    return struct.pack("!6H", ident, flags, *counts) + name + struct.pack("!HH", 1, 1) * bool(name) + more


def record(kind, data, name=b"\xc0\x0c"):
    return name + struct.pack("!HHIH", kind, 1, 60, len(data)) + data


def hello(host=b"a.example.test", version=0x0303, before=b"\0\x0a\0\x02\0\x1d"):
    names = b"\0" + struct.pack("!H", len(host)) + host
    extensions = before + struct.pack("!HHH", 0, len(names) + 2, len(names)) + names
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + struct.pack("!H", len(extensions)) + extensions
    shake = b"\x01" + len(body).to_bytes(3) + body
    return struct.pack("!BHH", 22, version, len(shake)) + shake


def test_sections():
    more = [record(1, bytes([192, 0, 2, 1])), record(28, bytes(15) + b"\1"), record(5, b"\x01b\xc0\x10"), record(15, b"\0\x05\xc0\x0c"), record(16, b"\x02hi\x01\xff"), record(99, bytes(30)), record(16, b"\x05x"), record(2, b"\xc0\xff")]
    found = dns.body(message(flags=0x8180, counts=(1, 8, 0, 0), more=b"".join(more)))
    assert found["complete"] and found["question"] == NAME[:-1].lower() + b"\0\1\0\1" and found["questions"] == [{"name": "www.Example.test", "type": "A", "class": "IN"}]
    assert [r["data"] for r in found["records"]] == ["192.0.2.1", "::1", "b.Example.test", "preference=5 exchange=www.Example.test", '"hi" "\\xff"', "0x" + "00" * 24 + "...", "<invalid-txt>", "<invalid-name>"]
    assert found["records"][5]["type"] == "TYPE99" and found["records"][0]["ttl"] == 60


@pytest.mark.parametrize("bad", [message(name=b"\x40"), message(name=b"\xc0\x0c"), message(name=b"\x3fabc"), message(name=(b"\x3f" + b"a" * 63) * 5 + b"\0"), message(counts=(1, 1, 0, 0)), message(counts=(2, 1024, 0, 0)), message(counts=(1, 1, 0, 0), more=record(1, b"abcd")[:-1])])
def test_bad_messages(bad):
    assert not dns.body(bad)["complete"]


def test_any_bytes():
    r = random.Random(2)
    assert dns.body(None) is None and dns.body(b"x" * 11) is None and tls.server_name(None) is None and dns.labels_at(b"\0", 0) == ([], 1)
    for base in (message(counts=(1, 1, 0, 0), more=record(15, b"\0\5\xc0\x0c")), hello()):
        for _ in range(2000):
            own = bytes(r.randrange(256) if r.random() < 0.05 else c for c in base[: r.randint(0, len(base))])
            dns.body(own), tls.server_name(own)


def test_server_names():
    assert tls.server_name(hello()) == tls.server_name(hello() + b"rest") == "a.example.test"
    assert tls.server_name(hello(b"x" * 63 + b".y")) and tls.server_name(hello(version=0x0301))
    for bad in (b"", b"a_b", b"-a", b"a-.b", b".a", b"a.", b"a..b", b"x" * 64, b"a" * 50 + b".b" * 110, b"a\n"):
        assert tls.server_name(hello(bad)) is None
    assert tls.server_name(hello(version=0x0305)) is None and tls.server_name(hello()[:-1]) is None and tls.server_name(hello(before=b"\0\x0a\0\0" * 64)) is None


def test_dns_fold():
    def run(*rows):
        flow, top = Flow(), 0
        for n, (ts, forward, ident, response, rcode, question) in enumerate(rows):
            top = max(top, ts)
            flow.take(n, ts, top, forward, ident, response, rcode, question, True)
        return flow.result()

    ms = 1000
    assert run((0, True, 1, False, 0, b"q"), (5 * ms, True, 1, False, 0, b"q"), (9 * ms, False, 1, True, 3, b"q")) == (1, 1, 0, 0, 1, 0, 9.0, 9.0, 9.0)
    assert run((0, True, 1, False, 0, b"q"), (5_000_001, False, 1, True, 0, b"q"))[:3] == (1, 0, 1)
    assert run((0, True, 1, False, 0, b"q"), (1, True, 1, False, 0, b"r"), (2, False, 1, True, 2, None))[:3] == (2, 0, 2)
    assert run((0, True, 1, False, 0, b"q"), (2, True, 1, True, 2, b"q"))[1] == 0 and run((0, True, 1, True, 2, b"q")) is None
    assert run(*((n, True, n, False, 0, b"q") for n in range(40)))[:4] == (32, 0, 32, 8)


def test_flow_records(spark, tmp_path):
    a, s = ("192.0.2.1", 5353), ("198.51.100.1", 53)
    c, t = ("2001:db8::1", 40000), ("2001:db8::2", 443)
    udp = lambda p, q, body: ether(0x0800, ip(p[0], q[0], 17, datagram(*p, *q, body)))
    tcp = lambda p, q, flags, seq, body=b"": ether(0x86DD, ip(p[0], q[0], 6, segment(*p, *q, flags, seq, 0, body)))
    frames = [udp(a, s, message()), tcp(c, t, 2, 9), udp(s, a, message(flags=0x8183)), tcp(c, t, 24, 10, hello()), tcp(c, t, 24, 300, hello(b"late.test"))]
    rows = decode(frames_of(spark, frames, 20_000).withColumn("link_type", F.lit(1)), *snapshots.FIELDS)
    found = snapshots.snapshots(flows.with_key(flows.eligible(flows.with_watermark(rows)))).cache()
    export.write_csv(found.coalesce(1), str(tmp_path / "csv"))
    export.write_json(found.coalesce(1), str(tmp_path / "json"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    lines = {r["protocol"]: r for r in csv.DictReader(file.open())}
    assert tuple(lines["udp"]) == export.CSV_COLUMNS and len(lines) == 2
    assert lines["udp"]["dns_nxdomain"] == "1" and lines["udp"]["dns_response_latency_avg_ms"] == "40.000" and lines["udp"]["tcp_state"] == "" and lines["udp"]["retransmissions"] == "0"
    assert lines["tcp"]["tls_sni"] == "a.example.test" and lines["tcp"]["endpoint_a_ip"] == "2001:db8::1" and lines["tcp"]["dns_queries"] == "" and lines["tcp"]["duration_secs"] == "0.060000"
    (file,) = (tmp_path / "json").glob("*.json")
    objects = {r["protocol"]: r for r in map(json.loads, file.open())}
    assert objects["udp"]["dns"]["matched_responses"] == 1 and objects["udp"]["endpoint_b"] == {"ip": "198.51.100.1", "port": 53} and objects["udp"]["tls_sni"] is None and objects["tcp"]["dns"] is None
    export.write_json_array(found, str(tmp_path / "array"))
    whole = json.loads("".join(f.read_text() for f in sorted((tmp_path / "array").glob("*.txt"))))
    assert sorted(whole, key=lambda r: r["protocol"]) == [objects["tcp"], objects["udp"]] and whole[0]["bytes_total"] >= whole[1]["bytes_total"]
    export.write_json_array(found.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("*.txt")))) == []
    assert export.csv_rows(snapshots.snapshots(flows.with_key(flows.eligible(flows.with_watermark(rows.limit(0)))))).count() == 0
