"""Summaries, layers, detectors, capped tables, deltas, sinks: small cases and brute force."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_packets import frames_of, linux_sll2, protocol_edges

from tracelake.functions import decode, packets, registry
from tracelake.operators import capped, detectors, flows
from tracelake.plans import metrics
from tracelake.sources import files, pcap

KEYED = "frame_no long, ts_us long, protocol string, a_ip long, a_port long, b_ip long, b_port long, wire_len long"


def decoded(spark, frames, link):
    return decode.decode(frames_of(spark, frames, 1).withColumn("link_type", F.lit(link)), *packets.NEEDED)


def test_summaries_and_layers(spark):
    rows = packets.layers(packets.summary(decoded(spark, protocol_edges(), 1))).orderBy("frame_no").collect()
    assert [r.shown_protocol for r in rows] == ["TCP", "UDP", "ICMP", "ICMPv6", "IPv4", "Unknown(0x88cc)"]
    assert rows[0].info == "[SYN] seq=77 ack=0 win=65535" and rows[0].source == "fd00:7::a:40100" and rows[2].info == "Echo Request id=2989 seq=5"
    assert [x.name for x in rows[1].layers] == ["Ethernet", "VLAN Tag 1 (802.1ad)", "VLAN Tag 2 (802.1Q)", "IPv4", "UDP"]
    assert {f.field: f.value for f in rows[3].layers[2].fields}["Identifier"] == "3085" and "Identifier" not in {f.field for f in rows[2].layers[2].fields}
    cooked = packets.layers(packets.summary(decoded(spark, linux_sll2(), 276))).orderBy("frame_no").collect()
    assert cooked[0].sll_interface == 16909060 and {f.field: f.value for f in cooked[0].layers[0].fields}["Packet Type"] == "outgoing (4)"
    assert cooked[6].info == "who-has 192.0.2.1 tell 192.0.2.10 (02:00:00:00:00:02)" and cooked[6].layers[1].name == "ARP"


def syns(seed, n=400):
    """Rows of one order: time that mostly grows, its running maximum, few targets and sources."""
    r, now, top, rows = random.Random(seed), 0, 0, []
    for i in range(n):
        now += r.choice((0, 1, 3, 20))
        ts = max(0, now - r.choice((0, 0, 0, 5, 40)))
        top = max(top, ts)
        rows.append((i, ts, top, r.randrange(6), r.randrange(2), r.randrange(4)))
    return rows


def plain_flood(rows, window, total, sources, cooldown):
    held, quiet, out = defaultdict(list), {}, []
    for _, ts, top, src, dst, port in rows:
        key = (dst, port)
        if quiet.get(key, -1) > top:
            continue
        held[key] = [x for x in held[key] if x[0] >= top - window]
        if top - ts > window:
            continue
        held[key].append((ts, src))
        if len(held[key]) >= total and len({s for _, s in held[key]}) >= sources:
            out.append((*key, ts, len(held[key]), len({s for _, s in held[key]})))
            quiet[key] = top + cooldown
    return out


def plain_scan(rows, window, ports, hosts, cooldown):
    held, quiet, out = defaultdict(list), {}, []
    for _, ts, top, src, dst, port in rows:
        if quiet.get(src, -1) > top:
            continue
        if top - ts <= window:
            held[src].append((ts, port, dst))
        recent = [x for x in held[src] if x[0] >= top - window]
        n_ports, n_hosts = len({x[1] for x in recent}), len({x[2] for x in recent})
        if top - ts <= window and ((ports and n_ports >= ports) or (hosts and n_hosts >= hosts)):
            out.append((src, ts, n_ports, n_hosts))
            quiet[src] = top + cooldown
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_against_brute_force(spark, seed):
    rows = syns(seed)
    df = spark.createDataFrame(rows, "frame_no long, ts_us long, watermark_us long, src_ip long, dst_ip long, dst_port long")
    df = df.withColumns({"protocol": F.lit("tcp"), "syn": F.lit(True), "ack": F.lit(False)})
    flood = detectors.syn_flood_alerts(df, 30, 3, 2, 50).select("dst_ip", "dst_port", "ts_us", "observed_total", "observed_values").collect()
    want = plain_flood(rows, 30, 3, 2, 50)
    assert want and sorted(map(tuple, flood)) == sorted(want)
    scan = detectors.port_scan_alerts(df, 30, 3, 2, 50).select("src_ip", "ts_us", "observed_values", "observed_hosts").collect()
    want = plain_scan(rows, 30, 3, 2, 50)
    assert want and sorted(map(tuple, scan)) == sorted(want)


def test_one_target_of_many_syns(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("frame_no"), (F.col("id") * 100).alias("ts_us"), (F.col("id") * 100).alias("watermark_us"), (F.col("id") % 5000).alias("src_ip"), F.lit(1).alias("dst_ip"), F.lit(443).alias("dst_port"))
    df = df.withColumns({"protocol": F.lit("tcp"), "syn": F.lit(True), "ack": F.lit(False)})
    top = detectors.syn_candidates(df, 5_000_000, 200, 50).agg(F.count("*"), F.max("n"), F.max("n_sources")).first()
    assert tuple(top) == (n - 199, 50_001, 5000)
    assert [r.ts_us for r in detectors.syn_flood_alerts(df).collect()] == [19_900]


def test_lives_of_flows_with_late_frames(spark):
    r = random.Random(3)
    rows, now = [], 0
    for i in range(600):
        now += r.choice((1, 5, 200, 900))
        rows.append((i, max(0, now - r.choice((0, 0, 300, 1500))), "tcp", 1, r.randrange(4), 2, 80, 60))
    packets_ = flows.with_watermark(spark.createDataFrame(rows, KEYED))
    swept = flows.sweeps(packets_, 400)
    got = {x.frame_no: x.instance for x in flows.instances(packets_, swept, 1000).collect()}
    table, life, last, top, want, ended = {}, defaultdict(int), None, 0, {}, {}
    for frame, ts, *key, _ in rows:
        top, key = max(top, ts), tuple(key)
        if key not in table:
            table[key] = [ts, life[key]]
            life[key] += 1
        table[key][0] = max(table[key][0], ts)
        want[frame] = table[key][1]
        if last is None or top - last >= 400:
            last = top
            for k in [k for k, e in table.items() if top - e[0] > 1000]:
                ended[k, table.pop(k)[1]] = last
    assert max(want.values()) > 3 and got == want
    bounded = {x.frame_no: x.instance for x in capped.admitted(packets_, swept, 0, 1000).collect()}
    assert bounded == want
    keyed = packets_.withColumn("a_to_b", F.lit(True))
    got = {(tuple(x[k] for k in flows.KEY), x.instance): x.expired_us for x in flows.lives(keyed, swept, 1000).collect()}
    assert {k: v for k, v in got.items() if v is not None} == ended and len(got) == sum(life.values())
    bounded = {(tuple(x[k] for k in flows.KEY), x.instance): x.ended_us for x in capped.admitted(packets_, swept, 0, 1000).collect()}
    assert bounded == got


def test_capped_table(spark):
    ports = [1001, 1002, 1003, 1004, 1002, 1005]
    rows = [(i, i, "udp", 1, p, 2, 53, 60) for i, p in enumerate(ports)]
    out = capped.admitted(spark.createDataFrame(rows, KEYED), None, 3).collect()
    assert {(r.a_port, r.ended_us) for r in out if r.reason == "eviction"} == {(1001, 3), (1003, 5)} and len(out) == 6
    many = capped.admitted(spark.createDataFrame([(i, i, "udp", 1, i, 2, 53, 60) for i in range(100)], KEYED), None, 2)
    assert many.filter("reason = 'eviction'").count() == 98


def test_deltas_since_the_last_report(spark):
    r = random.Random(9)
    rows = [(i, i * 10, "udp", 1, r.randrange(7), 2, 53, r.randint(1, 90)) for i in range(300)]
    got = [(x.tick, x.a_port, x.delta_bytes, x["rank"]) for x in flows.reported_deltas(spark.createDataFrame(rows, KEYED), 200, 2).orderBy("tick", "rank").collect()]
    open_, want = defaultdict(int), []
    for tick in range(15):
        for x in rows[tick * 20 : tick * 20 + 20]:
            open_[x[4]] += x[7]
        for rank, (size, port) in enumerate(sorted((-s, p) for p, s in open_.items() if s)[:2], 1):
            want.append((tick, port, -size, rank))
            open_[port] = 0
    assert got == want


def test_few_flows_reach_the_reports(spark, monkeypatch):
    """Only flows that can be reported go through the one task, those with ties at the edge and without a port too."""
    sent, old = [], flows.in_order

    def spy(rows, *rest):
        sent.append(rows.count())
        return old(rows, *rest)

    monkeypatch.setattr(flows, "in_order", spy)
    r = random.Random(10)
    rows = [(i, i, "udp", 1, None if (p := r.randrange(3000)) == 7 else p, 2, 53, 40 if p > 30 else 5000 + 40 * (p % 4)) for i in range(8000)]
    got = [(x.tick, x.a_port, x.delta_bytes, x["rank"]) for x in flows.reported_deltas(spark.createDataFrame(rows, KEYED), 1000, 3).orderBy("tick", "rank").collect()]
    open_, want = defaultdict(int), []
    for tick in range(8):
        for x in rows[tick * 1000 : tick * 1000 + 1000]:
            open_[x[4]] += x[7]
        for rank, (size, port) in enumerate(sorted(((-s, p) for p, s in open_.items() if s), key=lambda x: (x[0], -1 if x[1] is None else x[1]))[:3], 1):
            want.append((tick, port, -size, rank))
            open_[port] = 0
    assert got == want and len(sent) == 1 and 24 <= sent[0] < 500


def test_functions_for_sql(spark):
    registry.register(spark)
    row = spark.sql("SELECT hex_dump(unhex('00414243')) AS h, time_of_day(3661000007) AS t, tls_sni(unhex('16')) AS s, dns_decode(unhex('00')) AS d").first()
    assert row.h.startswith("0000  00 41 42 43 ") and row.h.endswith("|.ABC|\n") and row.t == "01:01:01.000007" and row.s is None and row.d is None
    message = "123481800001000100000000" + "0161" + "00" + "00010001" + "C00C" + "0001" + "0001" + "0000003C" + "0004" + "0A000001"
    got = spark.sql(f"SELECT * FROM dns_records(unhex('{message}'))").collect()
    assert [(r.section, r.name, r.type, r.ttl, r.data) for r in got] == [("answer", "a", "A", 60, "10.0.0.1")]


def test_appended_csv_and_private_files(spark, tmp_path):
    ended = {c: F.lit(1).cast("long") for c in ("packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a", "packets_total", "bytes_total", "retransmissions", "out_of_order", "rtt_samples")}
    blank = {c: F.lit(None).cast("string") for c in ("tcp_state", "client", "tls_sni")} | {c: F.lit(None).cast("double") for c in files.CSV_COLUMNS if c.endswith("_ms") or c.startswith("dns_")}
    rows = spark.range(2).select(F.lit("udp").alias("protocol"), *(F.unhex(F.lit("0A000001")).alias(f"{s}_ip") for s in "ab"), *(F.lit(5).alias(f"{s}_port") for s in "ab"), F.lit(0).alias("first_us"), F.lit(1).alias("last_us"), F.lit(1.0).alias("duration_secs"), F.lit(1.0).alias("avg_bps"), F.lit(7).alias("expired_us")).withColumns({**ended, **blank})
    path = str(tmp_path / "x.csv")
    assert files.append_expired_csv(rows, path) == files.append_expired_csv(rows, path) == 2
    lines = open(path).read().splitlines()
    assert len(lines) == 5 and len(lines[0].split(",")) == 35 and lines[1].startswith("0.000007,timeout,udp,10.0.0.1,5,") and os.stat(path).st_mode & 0o777 == 0o600
    old = tmp_path / "old.csv"
    old.write_bytes(b"\xef\xbb\xbf" + ",".join(files.EXPIRED_COLUMNS[:25]).encode() + b"\r\n")
    files.append_expired_csv(rows, str(old))
    assert len(old.read_text().splitlines()[1].split(",")) == 25
    other = tmp_path / "other.csv"
    other.write_text("a,b\n")
    with pytest.raises(ValueError):
        files.append_expired_csv(rows, str(other))
    assert other.read_text() == "a,b\n"
    os.symlink(path, tmp_path / "link.csv")
    os.link(other, tmp_path / "hard.csv")
    for bad in ("link.csv", "hard.csv"):
        with pytest.raises(OSError):
            files.open_private(str(tmp_path / bad))
    with pytest.raises(ValueError):
        files.distinct_targets([path, str(tmp_path / "link.csv")])
    assert other.read_text() == "a,b\n"


def test_rotation_goes_on(spark, tmp_path):
    frames = frames_of(spark, protocol_edges(), 1)
    for _ in range(2):
        pcap.write_pcap(frames, str(tmp_path / "out"), rotate_bytes=25, files=1, keep=8)
    assert sorted(p.name for p in (tmp_path / "out").glob("*.pcap")) == [f"part-{n:09d}.pcap" for n in range(4, 12)]


def test_metrics_text():
    text = metrics.render({"frames_read": 3, "wire_bytes": 180, "run_secs": 1.5, "kernel_drops": None}, 'a"b')
    assert 'build_info{version="a\\"b"} 1' in text and "capture_packets_total 3\n" in text and "drops" not in text and "detector" not in text and text.endswith("\n")
    counted = {"port_scan": dict.fromkeys(metrics.REASONS, 2)}
    assert metrics.render({"anomaly_saturation": counted}).count('detector="port_scan",reason=') == 4


def test_streamed_alerts(spark, tmp_path):
    from tracelake.streaming import detectors as streamed

    rows = [(i, i * 1000, "10.0.0.%d" % (i % 7), "10.1.1.1", 80) for i in range(60)]
    df = spark.createDataFrame(rows, "frame_no long, ts_us long, src_ip string, dst_ip string, dst_port long").withColumns({"protocol": F.lit("tcp"), "syn": F.lit(True), "ack": F.lit(False)})
    for k in range(3):
        df.filter(F.floor(F.col("frame_no") / 20) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streamed.syn_flood_alerts(stream, 1_000_000, 30, 5, 10_000_000)
    query = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert [(g["dst_port"], g["observed_total"], g["observed_values"]) for g in got] == [(80, 30, 7)]
