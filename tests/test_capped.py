"""The bounded flow table equals a plain one; it is replayed only where it can be full."""

import random
from collections import Counter, deque

import pytest

from tracelake.operators import capped, flows
from tracelake.sources.ordered import in_order

SCHEMA = "frame_no long, ts_us long, protocol string, a_ip long, a_port long, b_ip long, b_port long, wire_len long"


def plainly(rows, most, every, timeout):
    table, clock, born, top, last, seen, ends = {}, deque(), Counter(), None, None, {}, {}
    for frame, ts, _, _, port, *_ in rows:
        top = ts if top is None else max(top, ts)
        if port not in table:
            while most and len(table) >= most:
                first, life = clock.popleft()
                if first not in table or table[first][2] != life:
                    continue
                if table[first][1]:
                    table[first][1] = False
                    clock.append((first, life))
                else:
                    ends[first, table.pop(first)[2]] = (ts, "eviction")
            table[port] = [ts, True, born[port]]
            clock.append((port, born[port]))
            born[port] += 1
        table[port][:2] = max(table[port][0], ts), True
        seen[frame] = port, table[port][2]
        if timeout and (last is None or top >= last + every):
            last = top
            for old in [k for k, e in table.items() if top - e[0] > timeout]:
                ends[old, table.pop(old)[2]] = (last, "timeout")
    return {f: (*k, *ends.get(k, (None, None))) for f, k in seen.items()}


def bursts(seed, n, late=0.0, quiet=400, crowd=30):
    """A few flows most of the time, many in bursts that are apart."""
    r, now, rows = random.Random(seed), 0, []
    for i in range(n):
        busy = i // quiet % 2
        now += r.choice((1, 5, 40)) if busy else r.choice((20, 100, 700))
        port = r.randrange(crowd) if busy else r.randrange(100, 104)
        rows.append((i, now - (r.randrange(500) if r.random() < late else 0), "udp", 1, port, 2, 53, 60))
    return rows


@pytest.mark.parametrize("seed,late,most,timeout", [(1, 0, 8, 1000), (2, 0.1, 8, 1000), (3, 0.3, 5, 3000), (4, 0, 2, 300), (5, 0, 3, 0), (6, 0.2, 100, 500), (7, 0, 0, 500), (8, 0.05, 12, 60_000)])
def test_equals_the_plain_table(spark, monkeypatch, seed, late, most, timeout):
    monkeypatch.setattr(capped, "SPANS", 3 if seed % 2 else 64)
    rows = bursts(seed, 2600, late, 300)
    marked = flows.with_watermark(spark.createDataFrame(rows, SCHEMA))
    swept = flows.sweeps(marked, 200)
    out = capped.admitted(marked, swept, most, timeout).collect()
    got = {r.frame_no: (r.a_port, r.instance, r.ended_us, r.reason) for r in out}
    assert len(out) == len(rows) and got == plainly(rows, most, 200, timeout)
    assert most not in (2, 3, 5, 8) or any(x[3] == "eviction" for x in got.values())


def test_only_bursts_are_replayed(spark, monkeypatch):
    """Two bursts of 300 of 2,600 frames; nothing else reaches the replay."""
    sizes, old = [], capped._replay

    def spy(rows, *rest):
        counted = rows.filter("phase = 1 and kind = 0").groupBy("span").count().collect()
        sizes.extend((r["span"], r["count"]) for r in counted)
        return old(rows, *rest)

    monkeypatch.setattr(capped, "_replay", spy)
    rows = [x for x in bursts(9, 4000, 0, 300) if x[0] < 650 or x[0] >= 1800]
    rows = [(i, *x[1:]) for i, x in enumerate(rows) if not 700 < i < 1900 or x[4] >= 100]
    rows = [(i, *x[1:]) for i, x in enumerate(rows)][:1600]
    marked = flows.with_watermark(spark.createDataFrame(rows, SCHEMA))
    out = capped.admitted(marked, flows.sweeps(marked, 200), 8, 1000).collect()
    assert {r.frame_no: (r.a_port, r.instance, r.ended_us, r.reason) for r in out} == plainly(rows, 8, 200, 1000)
    assert len(sizes) >= 2 and sum(n for _, n in sizes) < len(rows) / 2
    sizes.clear()
    capped.admitted(marked, flows.sweeps(marked, 200), 1000, 1000).collect()
    assert not sizes


def test_no_task_sorts_the_trace(spark, monkeypatch):
    """A table that is always full: the task that replays the only span reads sorted files, it has no sort of its own."""
    plans, old = [], capped._replay

    def spy(*args):
        out = old(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(capped, "_replay", spy)
    r = random.Random(3)
    rows = [(i, i, "udp", 1, r.randrange(50), 2, 53, 60) for i in range(3000)]
    out = capped.admitted(spark.createDataFrame(rows, SCHEMA), None, 8).collect()
    assert {x.frame_no: (x.a_port, x.instance, x.ended_us, x.reason) for x in out} == plainly(rows, 8, 200, 0)
    assert len(plans) == 1 and "Sort" not in plans[0] and "Exchange" not in plans[0]


def test_rows_in_order(spark):
    """Groups over several files, one without rows, binary values and nulls."""
    r = random.Random(4)
    rows = [(r.randrange(1, 4), i, None if i % 5 == 0 else bytes([i % 256])) for i in range(5000)]
    r.shuffle(rows)
    run = lambda batches: batches
    out = in_order(spark.createDataFrame(rows, "g int, n long, x binary"), ["n"], "g", [1, 2, 3, 4], run, "g int, n long, x binary")
    assert [(x.g, x.n, x.x) for x in out.collect()] == sorted(rows, key=lambda x: x[:2])
    assert in_order(spark.createDataFrame([], "g int, n long"), ["n"], "g", [1], run, "g int, n long").count() == 0
