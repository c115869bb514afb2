"""Stored frames by number; what streams report."""

import random
import time

from pyspark.sql import functions as F

from tracelake.operators import flows
from tracelake.sources.packet_store import PacketStore
from tracelake.streaming.events import RunEvents


def test_store_against_a_plain_ring(spark, tmp_path):
    r, capacity = random.Random(4), 50
    store, ring, top = PacketStore(spark, str(tmp_path / "store"), capacity, 16), {}, None
    for k in range(4):
        ids = r.sample(range(k * 60, k * 60 + 90), 40)
        store.put(spark.createDataFrame([(i, f"{k}.{i}") for i in ids], "frame_no long, raw string").repartition(3))
        for i in ids:
            if top is None or i > top - capacity:
                ring[i] = f"{k}.{i}"
        top = max([*ids, *([top] if top is not None else [])])
        want = {i: x for i, x in ring.items() if i > top - capacity}
        got = store.get(list(range(400))).collect()
        assert {x.frame_no: x.raw for x in got} == want and len(got) == len(want)
        assert store.buckets()[0] >= (top - capacity + 1) // 16
    some = spark.createDataFrame([(i,) for i in [*list(want)[:3], 7, 10_000]], "frame_no long")
    assert {x.frame_no for x in store.get(some).collect()} == set(list(want)[:3])
    plan = store.get([top])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"(bucket#" in plan and "PushedFilters: [" in plan


def test_nothing_is_stored_without_capacity(spark, tmp_path):
    store = PacketStore(spark, str(tmp_path / "store"), 0)
    store.put(spark.createDataFrame([(1, "a")], "frame_no long, raw string"))
    assert store.largest() is None and store.buckets() == []


def test_events_of_a_stream(spark, tmp_path):
    for k, second in enumerate((100, 200, 10)):  # the last file is late
        spark.createDataFrame([(second,)], "s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    events = RunEvents()
    spark.streams.addListener(events)
    try:
        stream = spark.readStream.schema("s long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counts = stream.withColumn("ts", F.timestamp_seconds("s")).withWatermark("ts", "5 seconds").groupBy(F.window("ts", "10 seconds")).count()
        query = counts.writeStream.format("noop").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run = str(query.runId)
        query.awaitTermination(120)
        for _ in range(100):
            if events.state.get(run) == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(events)
    rows = events.rows(spark).filter(F.col("run") == run).collect()
    assert rows[0].kind == "started" and rows[-1].kind == "ended" and not events.ready(run)
    progress = [r for r in rows if r.kind == "progress"]
    assert sum(r.rows for r in progress) == 3 and events.dropped(run) == sum(r.late_rows for r in progress) == 1
    assert {r.query for r in progress} == {"counts"} and max(r.lag_seconds or 0 for r in progress) >= 5


def test_two_consumers_of_deltas(spark):
    r = random.Random(9)
    rows = [(i, i * 10, "udp", 1, r.randrange(7), 2, 53, r.randint(1, 90)) for i in range(300)]
    packets = spark.createDataFrame(rows, "frame_no long, ts_us long, protocol string, a_ip long, a_port long, b_ip long, b_port long, wire_len long")
    both = flows.consumers(packets, {"stats": (200, 2), "web": (500, 3)})
    for name, (every, n) in {"stats": (200, 2), "web": (500, 3)}.items():
        alone = flows.reported_deltas(packets, every, n)
        assert sorted(map(tuple, both.filter(F.col("consumer") == name).select(*alone.columns).collect())) == sorted(map(tuple, alone.collect()))
