"""Streams over capture files, and packets as text."""

import pytest
from pyspark.sql import functions as F

from tests.test_packets import START, frames_of, tcp4
from tracelake.functions import formats
from tracelake.functions.decode import decode
from tracelake.operators import flows
from tracelake.sources import pcap
from tracelake.streaming import flows as streams


def test_streams_equal_batch(spark, tmp_path):
    a, b = ("192.0.2.1", 1000), ("198.51.100.1", 80)
    calls = [(a, b, 0), (b, a, 1), (a, b, 2), (("192.0.2.9", 5), b, 2), (a, b, 40), (b, a, 41), (("192.0.2.9", 5), b, 300)]
    rows = [(i + 1, START + at * 1_000_000, 60 + i, bytearray(tcp4(*s, *d, 16, i))) for i, (s, d, at) in enumerate(calls)]
    frames = spark.createDataFrame(rows, "frame_no long, ts_us long, wire_len long, raw binary")
    pcap.write_pcap(frames, str(tmp_path / "in"), rotate_bytes=200, files=1)
    assert len(list((tmp_path / "in").glob("*.pcap"))) > 2

    def run(name, make):
        packets = decode(pcap.stream_pcap(spark, str(tmp_path / "in"), 1), "protocol", "src_ip", "dst_ip", "src_port", "dst_port")
        query = make(packets).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    # Packets of the last frame's time stay in the state: the watermark doesn't pass them.
    ended = run("ended", lambda p: streams.ended_flows(p, "20 seconds", "0 seconds"))
    assert sorted((r.packets_total, r.bytes_total, r.duration_secs) for r in ended) == [(1, 63, 0.0), (2, 129, 1.0), (3, 183, 2.0)]
    packets = flows.with_key(flows.eligible(decode(pcap.read_pcap(spark, str(tmp_path / "in")), "protocol", "src_ip", "dst_ip", "src_port", "dst_port")))
    want = {(r.tick, r.bytes, r.packets, r.active_flows, r.mbps) for r in flows.ticks(packets, 1_000_000).collect() if r.tick < START // 1_000_000 + 300}
    got = run("ticks", lambda p: streams.ticks(p, "1 second", "0 seconds").withColumn("tick", F.unix_seconds("start")))
    assert {(r.tick, r.bytes, r.packets, r.active_flows, r.mbps) for r in got} == want and len(want) == 5


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 16, 17, 40, 300])
def test_hex_dump(spark, size):
    data, want = bytes((i * 37) % 256 for i in range(size)), ""
    for at in range(0, size, 16):
        part = data[at : at + 16]
        cells = [f"{c:02x} " for c in part] + ["   "] * (16 - len(part))
        want += f"{at:04x}  {''.join(cells[:8])} {''.join(cells[8:])} |{''.join(chr(c) if 32 <= c < 127 else '.' for c in part)}|\n"
    row = spark.createDataFrame([(bytearray(data), 86_399_000_042)], "raw binary, ts long").select(formats.hex_dump(F.col("raw")), formats.time_of_day(F.col("ts"))).first()
    assert tuple(row) == (want, "23:59:59.000042")


def test_flag_text(spark):
    row = spark.range(1).select(*(F.lit(f in ("ack", "syn")).alias(f) for f in formats.FLAGS), F.lit(None).cast("binary").alias("raw"))
    assert tuple(row.select(formats.flag_text(), formats.hex_dump(F.col("raw"))).first()) == ("[SYN, ACK]", None)
