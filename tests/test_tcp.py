"""The TCP fold over whole batches equals the fold packet by packet."""

import random

import pytest

from tracelake.functions.automaton import Automaton
from tracelake.operators import flows, tcp

SCHEMA = "frame_no long, ts_us long, protocol string, a_ip long, a_port long, b_ip long, b_port long, a_to_b boolean, syn boolean, ack boolean, fin boolean, rst boolean, seq long, ack_no long, seq_len long"
WRAP = 1 << 32


def traffic(seed, n, flows_, jumps=0.0):
    """Packets of flows whose sides send near a place of their own, often around the wrap; acknowledgements near what
    the other side sent, sometimes far off."""
    r = random.Random(seed)
    place = {(f, s): r.choice((0, 100, WRAP - 3000, WRAP // 2)) for f in range(flows_) for s in (0, 1)}
    now, rows = 0, []
    for i in range(n):
        f, s = min(int(r.expovariate(0.3)), flows_ - 1), r.randrange(2)
        now += r.choice((0, 1, 700, 90_000))
        if r.random() < jumps:
            place[f, s] = r.randrange(WRAP)
        seq, length = place[f, s] % WRAP, r.choice((0, 0, 1, 500, 1400))
        if r.random() < 0.7:
            place[f, s] += length
        else:
            seq = (seq + r.choice((-2000, -500, 0, 900))) % WRAP
        number = (place[f, 1 - s] + r.choice((0, 0, 0, -1400, -5000, 3000))) % WRAP if r.random() > jumps else r.randrange(WRAP)
        flags = [r.random() < p for p in (0.05, 0.7, 0.06, 0.02)]
        rows.append((i, max(0, now - r.choice((0, 0, 50_000))), "tcp", 1, f, 2, 80, bool(s), *flags, seq, number, length))
    return rows


def plainly(rows):
    found = {}
    for _, ts, _, *key, forward, syn, ack, fin, rst, seq, number, length in rows:
        found.setdefault(tuple(key), tcp.Flow()).take(ts, int(forward), syn, ack, fin, rst, seq, number, length)
    return {k: f.result() for k, f in found.items()}


def folded(spark, rows):
    out = tcp.tcp_flows(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {tuple(r[c] for c in flows.KEY[1:]): tuple(r[c] for c in tcp.RESULT) for r in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("seed,n,count,jumps", [(1, 3000, 40, 0), (2, 3000, 4, 0), (3, 4000, 10, 0.01), (4, 600, 200, 0.3)])
@pytest.mark.parametrize("together", [1, 97, 1 << 16])
def test_batches_equal_packets(spark, monkeypatch, seed, n, count, jumps, together):
    monkeypatch.setattr(tcp, "TOGETHER", together)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50" if together < 100 else "10000")
    try:
        rows = traffic(seed, n, count, jumps)
        assert folded(spark, rows) == plainly(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_is_folded_plainly_without_jumps(monkeypatch):
    import numpy as np

    rows = sorted(traffic(5, 5000, 9), key=lambda x: (x[4], x[0]))
    key = np.array([x[4] for x in rows])
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    columns = [np.array([x[i] for x in rows]) for i in (1, 7, 8, 9, 10, 11, 12, 13, 14)]
    columns[1] = columns[1].astype(np.int64)
    batch = tcp.Batch(columns, heads, None)
    assert not batch.redone and batch.counts["samples"].sum() > 100 and batch.counts["retransmissions"].sum() > 50
    monkeypatch.setattr(tcp.Batch, "_plainly", None)
    tcp.Batch(columns, heads, None)


def test_more_in_flight_than_is_kept(spark):
    """300 segments wait, of which the last 128 are kept; one acknowledgement meets them all."""
    rows = [(i, i * 10, "tcp", 1, 5, 2, 80, True, False, False, False, False, i * 100, 0, 100) for i in range(300)]
    rows += [(300, 5000, "tcp", 1, 5, 2, 80, False, False, True, False, False, 0, 30_000, 0), (301, 6000, "tcp", 1, 5, 2, 80, True, False, False, False, False, 100, 0, 100)]
    found = folded(spark, rows)
    assert found == plainly(rows) and found[1, 5, 2, 80][7] == 128 and found[1, 5, 2, 80][2] == 1


def test_null_flags(spark):
    rows = [(1, 1, "tcp", 1, 5, 2, 80, True, None, None, None, None, None, None, None), (2, 1, "tcp", 1, 6, 2, 80, True, True, None, None, None, 5, None, 1)]
    assert {k[1]: v[0] for k, v in folded(spark, rows).items()} == {5: "unknown", 6: "syn_sent"} and folded(spark, rows[:0]) == {}


def test_automaton():
    r, machine = random.Random(1), Automaton(lambda s, x: (s + x) % 5 if x < 3 else 0, 5, 4)
    import numpy as np

    for n in (0, 1, 63, 64, 65, 1000):
        symbols, starts = np.array([r.randrange(4) for _ in range(n)], int), np.array([r.random() < 0.1 for _ in range(n)], bool)
        want, s = [], 3
        for x, new in zip(symbols.tolist(), starts.tolist()):
            s = 0 if new else s
            s = (s + x) % 5 if x < 3 else 0
            want.append(s)
        assert machine.states(symbols, starts, 3).tolist() == want
