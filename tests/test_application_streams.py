"""TCP and DNS state over streams: what batches give, in micro-batches; state that timers end."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_packets import START
from tests.test_tcp import traffic
from tracelake.operators import dns, flows, tcp
from tracelake.streaming import applications

TCP = "frame_no long, ts_us long, protocol string, src_ip long, src_port long, dst_ip long, dst_port long, wire_len long, syn boolean, ack boolean, fin boolean, rst boolean, seq long, ack_no long, seq_len long"
DNS = "frame_no long, ts_us long, protocol string, a_ip long, a_port long, b_ip long, b_port long, a_to_b boolean, dns_id long, response boolean, opcode int, rcode long, question_count int, question binary, complete boolean"


def streamed(spark, folder, df, make, batches):
    edges = [i * df.count() // batches for i in range(batches + 1)]
    for a, b in zip(edges, edges[1:]):
        df.filter((F.col("frame_no") >= a) & (F.col("frame_no") < b)).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = make(stream)
    query = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.read.schema(out.schema).parquet(str(folder / "out")), query


@pytest.mark.parametrize("together", [2, 10_000])
def test_tcp_stream_ends_with_the_batch(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(applications, "TOGETHER", together)
    rows = []
    for frame, ts, _, _, port, _, _, forward, *rest in sorted(traffic(7, 900, 12, 0.002), key=lambda x: x[0]):
        ends = ((1, port), (2, 80)) if forward else ((2, 80), (1, port))
        rows.append((frame, START + ts, "tcp", *ends[0], *ends[1], 60, *rest))
    far = max(r[1] for r in rows) + 10_000_000_000
    rows += [(len(rows) + i, far + i * 5_000_000_000, "tcp", 9, 9, 8, 8, 60, False, True, False, False, 1, 1, 0) for i in range(3)]
    df = spark.createDataFrame(rows, TCP)
    out, query = streamed(spark, tmp_path, df, lambda s: applications.tcp_flows(s, "2 hours", "1 hour"), 6)
    keys = [*flows.KEY, *tcp.RESULT]
    got = {tuple(r) for r in out.select(*keys).collect() if r.a_ip == 1}
    assert got == {tuple(r) for r in tcp.tcp_flows(flows.with_key(df)).select(*keys).collect() if r.a_ip == 1} and len(got) == 12
    # Timers have ended all of these flows, and what they kept is gone.
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal < 10
    assert out.filter("a_ip = 1").agg(F.max("last_us")).first()[0] < far


def test_dns_stream_ends_with_the_batch(spark, tmp_path):
    r, now, rows = random.Random(3), START, []
    for i in range(600):
        now += r.choice((0, 1000, 400_000, 3_000_000))
        response = r.random() < 0.45
        bare = response and r.random() < 0.1
        rows.append((i, now, "udp", 1, r.randrange(5), 2, 53, response ^ True, r.randrange(6), response, 0, r.choice((0, 2, 3)), int(not bare), None if bare else bytearray(b"q%d" % r.randrange(2)), r.random() < 0.95))
    far = now + 10_000_000_000
    rows += [(600 + i, far + i * 5_000_000_000, "udp", 9, 9, 8, 53, True, 1, False, 0, 0, 1, bytearray(b"q"), True) for i in range(3)]
    df = spark.createDataFrame(rows, DNS)
    keys = [*flows.KEY, *dns.RESULT]
    want = {tuple(x) for x in dns.dns_flows(df.withColumn("watermark_us", F.col("ts_us"))).select(*keys).collect() if x.a_ip == 1}
    out, _ = streamed(spark, tmp_path, df, lambda s: applications.dns_flows(s, "2 hours", "1 hour"), 5)
    got = {tuple(x) for x in out.select(*keys).collect() if x.a_ip == 1}
    assert got == want and len(got) == 5 and any(x[6] for x in got)
