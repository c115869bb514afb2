"""The chain of sweeps, found in parallel, equals the chain found frame by frame."""

import random

import numpy as np
import pytest

from tracelake.operators import flows, sweeps


def plainly(rows, every):
    last, top, out = None, None, []
    for frame, ts in rows:
        top = ts if top is None else max(top, ts)
        if last is None or top >= last + every:
            last = top
            out.append((frame, top))
    return out


def trace(seed, n, steps, late=0.1, start=0):
    r, now, rows = random.Random(seed), start, []
    for i in range(n):
        now += r.choice(steps)
        rows.append((i, now - (r.randrange(2000) if r.random() < late else 0)))
    return rows


@pytest.mark.parametrize("every,slots,group,steps,start", [(400, 16, 1024, (0, 1, 30, 300), 0), (400, 2, 2, (0, 1, 30, 300), -12_345), (50, 2, 3, (0, 49, 50, 51, 700), 0), (1000, 4, 2, (1,), 7), (7, 16, 4, (0, 5000, 90_000), -99), (1, 2, 2, (0, 1, 2), 0)])
def test_equals_the_plain_chain(spark, monkeypatch, every, slots, group, steps, start):
    monkeypatch.setattr(sweeps, "TOGETHER", 100)
    monkeypatch.setattr(sweeps, "SLOTS", slots)
    monkeypatch.setattr(sweeps, "GROUP", group)
    rows = trace(every + slots, 3000, steps, start=start)
    marked = flows.with_watermark(spark.createDataFrame(rows, "frame_no long, ts_us long").repartition(5))
    top, want = None, {}
    for frame, ts in rows:
        top = ts if top is None else max(top, ts)
        want[frame] = top
    assert {r.frame_no: r.watermark_us for r in marked.collect()} == want
    got = [tuple(r) for r in flows.sweeps(marked, every).orderBy("frame_no").collect()]
    assert got == plainly(rows, every)


def test_no_frames(spark):
    empty = spark.createDataFrame([], "frame_no long, ts_us long")
    assert flows.sweeps(flows.with_watermark(empty)).count() == 0


def test_maps_compose():
    r = random.Random(3)
    for _ in range(200):
        every, wide = 10, 40
        marks = np.array(sorted(r.sample(range(160), r.randint(1, 60))))
        slots = [(s, marks[(marks >= s * wide) & (marks < (s + 1) * wide)]) for s in range(4)]
        maps = [(s, sweeps.jumps(np.full(len(m), s), m, every, wide)[1:]) for s, m in slots if len(m)]
        together = sweeps.jumps(marks // wide, marks, every, wide)
        assert together[1].tolist() == np.concatenate([m[0] for _, m in maps]).tolist() and together[2].tolist() == np.concatenate([m[1] for _, m in maps]).tolist()
        whole = maps[0][1]
        for _, one in maps[1:]:
            whole = sweeps.compose(whole, one, every)
        for entry in range(-3, every):
            want = entry
            while (at := np.searchsorted(marks, want)) < len(marks):
                want = int(marks[at]) + every
            assert sweeps.ask(entry, *whole) == want
            step = entry
            for _, one in maps:
                step = sweeps.ask(step, *one)
            assert step == want


def test_one_task_sees_no_frames(spark):
    """The plan's only single task reads a row a group, not marks."""
    rows = trace(5, 20_000, (1000, 90_000), 0)
    made = flows.sweeps(flows.with_watermark(spark.createDataFrame(rows, "frame_no long, ts_us long")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning(1)") <= 1 and made.count() > 500
