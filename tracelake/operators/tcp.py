"""The state of TCP flows: connection state, round-trip times, retransmissions and out-of-order segments.

Each needs a flow's packets in frame order. ``Flow`` says what happens, packet by packet. ``Batch`` computes the
same for all flows of a batch at once: the connection state is a scan over a finite automaton; the highest sequence
number of a side is a running maximum of unwrapped numbers; what an acknowledgement finds waiting is a search
among the ends that raised it. A flow whose numbers jump by more than half their range can't be unwrapped; it
goes through ``Flow``. The last flow of a batch is carried into the next one as a ``Flow``, at most IN_FLIGHT
waiting segments a side, so a flow of any length takes bounded memory.
"""

from __future__ import annotations

from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.automaton import Automaton
from tracelake.operators.flows import KEY

#: Segments of a direction whose acknowledgement is awaited; the oldest goes first.
IN_FLIGHT = 128
#: Weight of the past in the smoothed round-trip time.
PAST = 0.875
#: Rows that are computed together, at least, but at the end.
TOGETHER = 1 << 16
RESULT = {"tcp_state": "string", "client": "string", "retransmissions": "long", "out_of_order": "long", "rtt_last_ms": "double", "rtt_min_ms": "double", "rtt_ewma_ms": "double", "rtt_samples": "long"}
_SIDES = ("b_to_a", "a_to_b")
_NAMES = ("unknown", "syn_sent", "syn_ack", "established", "fin_wait", "closed", "reset")
_WRAP, _HALF = 1 << 32, 1 << 31


def behind(a: int, b: int) -> bool:
    """Whether sequence number a is at or before b, modulo 2^32."""
    return (b - a) % _WRAP <= _HALF


class Flow:
    """The fold of one flow; side 1 is a to b, side 0 b to a."""

    def __init__(self):
        self.state, self.client, self.closed_sides = "unknown", None, set()
        self.retransmissions = self.out_of_order = self.samples = 0
        self.last = self.least = self.smooth = None
        self.top, self.acked, self.waiting = [None, None], [None, None], [deque(maxlen=IN_FLIGHT), deque(maxlen=IN_FLIGHT)]

    def turn(self, side: int, syn: bool, ack: bool, fin: bool, rst: bool) -> None:
        if rst:
            self.state = "reset"
        elif syn and ack:
            self.state = "syn_ack"
        elif syn:
            self.client = _SIDES[side] if self.client is None else self.client
            self.closed_sides, self.state = set(), "syn_sent"
        elif fin and self.state not in ("reset", "closed"):
            self.closed_sides.add(side)
            self.state = "closed" if len(self.closed_sides) == 2 else "fin_wait"
        elif ack and not fin and self.state not in ("reset", "closed", "fin_wait"):
            self.state = "established"

    def acknowledge(self, side: int, ts: int, number: int) -> None:
        queue, found = self.waiting[1 - side], []
        while queue and behind(queue[0][0], number):
            found.append(max(ts - queue.popleft()[1], 0) / 1000)
        if found:
            # Of several samples in one acknowledgement, an existing minimum meets only the last.
            self.least = min(found) if self.least is None else min(self.least, found[-1])
            for ms in found:
                self.smooth = ms if self.smooth is None else PAST * self.smooth + (1 - PAST) * ms
            self.last, self.samples = found[-1], self.samples + len(found)
        self.acked[1 - side] = number

    def segment(self, side: int, ts: int, seq: int, length: int) -> None:
        end = (seq + length) % _WRAP
        if self.top[side] is None or not behind(end, self.top[side]):
            self.top[side] = end
            self.waiting[side].append((end, ts))
        elif self.acked[side] is not None and behind(end, self.acked[side]):
            self.retransmissions += 1
        else:
            self.out_of_order += 1

    def take(self, ts: int, side: int, syn: bool, ack: bool, fin: bool, rst: bool, seq: int, number: int, length: int) -> None:
        self.turn(side, syn, ack, fin, rst)
        if ack:
            self.acknowledge(side, ts, number)
        if length:
            self.segment(side, ts, seq, length)

    def result(self) -> tuple:
        return self.state, self.client, self.retransmissions, self.out_of_order, self.last, self.least, self.smooth, self.samples


# The connection state as an automaton: a state is a name and the sides that are closed; symbols are what turn() tells apart.
_RST, _SYN_ACK, _SYN, _FIN_B, _FIN_A, _ACK, _NONE = range(7)


def _move(state: int, symbol: int) -> int:
    flow = Flow()
    flow.state, flow.closed_sides = _NAMES[state // 4], {s for s in (0, 1) if state >> s & 1}
    flow.turn(int(symbol == _FIN_A), symbol in (_SYN, _SYN_ACK), symbol in (_ACK, _SYN_ACK), symbol in (_FIN_B, _FIN_A), symbol == _RST)
    return _code(flow)


def _code(flow: Flow) -> int:
    return 4 * _NAMES.index(flow.state) + sum(1 << s for s in flow.closed_sides)


@cache
def _machine() -> Automaton:
    return Automaton(_move, 4 * len(_NAMES), 7)


COLUMNS = ("ts_us", "a_to_b", "syn", "ack", "fin", "rst", "seq", "ack_no", "seq_len")


class Batch:
    """All flows of a batch. rows: arrays of COLUMNS, sorted by flow and frame; heads: where flows begin, from 0
    on; ``carried``: what the rows before made of the first flow, if it began there."""

    def __init__(self, rows: list[np.ndarray], heads: np.ndarray, carried: Flow | None):
        self.rows, self.heads, self.carried = rows, heads, carried
        self.n, self.flows = len(rows[0]), len(heads)
        self.of = np.repeat(np.arange(self.flows), np.diff(np.append(heads, self.n)))
        self.bad = np.zeros(self.flows, bool)
        self.counts = {c: np.zeros(self.flows, np.int64) for c in ("retransmissions", "out_of_order", "samples")}
        self.times = {c: np.full(self.flows, np.nan) for c in ("last", "least", "smooth")}
        if carried is not None:
            for c in self.counts:
                self.counts[c][0] = getattr(carried, c)
            for c in self.times:
                if getattr(carried, c) is not None:
                    self.times[c][0] = getattr(carried, c)
        self._states()
        self._segments()
        self._acknowledgements()
        self.redone = {f: self._plainly(f) for f in np.flatnonzero(self.bad).tolist()}

    def _states(self) -> None:
        _, side, syn, ack, fin, rst, *_ = self.rows
        symbol = np.select([rst, syn & ack, syn, fin, ack], [_RST, _SYN_ACK, _SYN, np.where(side == 1, _FIN_A, _FIN_B), _ACK], _NONE)
        starts = np.zeros(self.n, bool)
        starts[self.heads] = True
        starts[0] = self.carried is None
        after = _machine().states(symbol, starts, 0 if self.carried is None else _code(self.carried))
        self.state = after[np.append(self.heads[1:], self.n) - 1]
        self.client = np.full(self.flows, -1)
        asked = np.flatnonzero(symbol == _SYN)
        flow, first = np.unique(self.of[asked], return_index=True)
        self.client[flow] = side[asked[first]]
        if self.carried is not None and self.carried.client is not None:
            self.client[0] = _SIDES.index(self.carried.client)

    def _after(self, side: np.ndarray, order: np.ndarray, flow: np.ndarray) -> np.ndarray:
        """One number for (flow, side, row), in that order; what was carried comes before row 0."""
        return (flow * 2 + side) * (self.n + 1) + order + 1

    def _segments(self) -> None:
        """Running maxima, and what does not raise them. Keeps the ends that do: line (flow and side), end, time and place."""
        ts, side, _, ack, _, _, seq, number, length = self.rows
        at = np.flatnonzero(length > 0)
        kept = [(s, e, t, True) for s in (0, 1) for e, t in self.carried.waiting[s]] if self.carried is not None else []
        kept += [(s, self.carried.top[s], 0, False) for s in (0, 1) if self.carried.top[s] is not None] if self.carried is not None else []
        old = [np.array(x) for x in zip(*kept)] if kept else [np.empty(0, np.int64)] * 4
        m = len(kept)
        row = np.concatenate([np.full(m, -1), at])
        line = np.concatenate([old[0], self.of[at] * 2 + side[at]]).astype(np.int64)
        end = np.concatenate([old[1], (seq[at] + length[at]) % _WRAP]).astype(np.int64)
        time = np.concatenate([old[2], ts[at]]).astype(np.int64)
        waits = np.concatenate([old[3].astype(bool), np.ones(len(at), bool)])
        order = np.argsort(line, kind="stable")
        row, line, end, time, waits = (x[order] for x in (row, line, end, time, waits))
        size = len(line)
        first = np.ones(size, bool)
        first[1:] = line[1:] != line[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(size), 0))
        step = np.zeros(size, np.int64)
        step[1:] = (end[1:] - end[:-1] + _HALF) % _WRAP - _HALF
        step[first] = 0
        moved = np.cumsum(step)
        far = end[head] + moved - moved[head] if size else end
        ranked = np.lexsort((far, line))
        rank = np.empty(size, np.int64)
        rank[ranked] = np.arange(size)
        top = far[ranked[np.maximum.accumulate(rank)]] if size else far
        before = np.concatenate([far[:1], top[:-1]])
        ahead = far - before
        rises = first | (ahead > 0)
        odd = ~first & ((ahead < -_HALF) | (ahead >= _HALF))
        self.bad[line[odd] // 2] = True
        # The last acknowledgement of a side before each segment.
        acks = np.flatnonzero(ack)
        told = [(s, self.carried.acked[s]) for s in (0, 1) if self.carried.acked[s] is not None] if self.carried is not None else []
        ack_line = np.concatenate([[s for s, _ in told], self.of[acks] * 2 + 1 - side[acks]]).astype(np.int64)
        ack_row, ack_number = np.concatenate([np.full(len(told), -1), acks]), np.concatenate([[x for _, x in told], number[acks]]).astype(np.int64)
        place = ack_line * (self.n + 1) + ack_row + 1
        order = np.argsort(place, kind="stable")
        place, ack_line, ack_row, ack_number = place[order], ack_line[order], ack_row[order], ack_number[order]
        late = np.flatnonzero(~rises & (row >= 0))
        last = np.searchsorted(place, line[late] * (self.n + 1) + row[late] + 1, side="right") - 1
        known = last >= 0
        known[known] = ack_line[last[known]] == line[late][known]
        again = known.copy()
        again[known] = (ack_number[last[known]] - end[late[known]]) % _WRAP <= _HALF
        self.counts["retransmissions"] += np.bincount(line[late[again]] // 2, minlength=self.flows)
        self.counts["out_of_order"] += np.bincount(line[late[~again]] // 2, minlength=self.flows)
        self.acks = (ack_line, ack_row, ack_number, place)
        self.tops = (line, top)
        rises &= waits
        self.ends = (line[rises], far[rises], time[rises], line[rises] * (self.n + 1) + row[rises] + 1)

    def _acknowledgements(self) -> None:
        line, far, time, at = self.ends
        ack_line, ack_row, number, place = (x[self.acks[1] >= 0] for x in self.acks)
        begin, upto = np.searchsorted(line, ack_line), np.searchsorted(at, place)  # of the line; ends before the acknowledgement
        some = upto > begin
        top = far[np.maximum(upto, 1) - 1] if len(far) else np.zeros(len(upto), np.int64)
        gap = (number - top) % _WRAP
        aim = top + np.where(gap <= _HALF, gap, gap - _WRAP)
        # Ends at or before the number acknowledged, by merging both lists.
        both = np.lexsort((np.repeat([0, 1], [len(far), len(aim)]), np.concatenate([far, aim]), np.concatenate([line, ack_line])))
        passed = np.cumsum(both < len(far))
        reached = np.empty(len(aim), np.int64)
        reached[both[both >= len(far)] - len(far)] = passed[both >= len(far)]
        reached = np.where(some, np.clip(reached, begin, upto), begin)
        so_far = np.concatenate([[0], np.maximum.accumulate(reached)[:-1]]) if len(reached) else reached
        low = np.maximum(np.maximum(so_far, upto - IN_FLIGHT), begin)
        held = low < upto
        self.bad[ack_line[held][aim[held] - far[low[held]] > _HALF] // 2] = True
        self.popped = (ack_line, np.maximum(reached, low))
        n = np.maximum(reached - low, 0)
        hit = np.flatnonzero(n)
        hit = hit[np.argsort(ack_row[hit], kind="stable")]
        if not len(hit):
            return
        n, low, flow = n[hit], low[hit], ack_line[hit] // 2
        edges = np.concatenate([[0], np.cumsum(n)])
        entry = np.arange(edges[-1]) - np.repeat(edges[:-1] - low, n)
        ms = np.maximum(np.repeat(self.rows[0][ack_row[hit]], n) - time[entry], 0) / 1000
        newest = ms[edges[1:] - 1]
        new = np.concatenate([[True], flow[1:] != flow[:-1]])
        heads = np.flatnonzero(new)
        shown = np.where(new & np.isnan(self.times["least"][flow]), np.minimum.reduceat(ms, edges[:-1]), newest)
        own = flow[heads]
        self.times["least"][own] = np.fmin(self.times["least"][own], np.minimum.reduceat(shown, heads))
        self.times["last"][own] = newest[np.append(heads[1:], len(flow)) - 1]
        sizes = np.add.reduceat(n, heads)
        self.counts["samples"][own] += sizes
        self._smooth(own, edges[heads], sizes, ms)

    def _smooth(self, flow: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ms: np.ndarray) -> None:
        """Smoothed times in the order of samples: side by side for short lists, one by one for long ones."""
        value = self.times["smooth"]
        for k in range(min(int(sizes.max()), 64)):
            has = sizes > k
            x, old = ms[begin[has] + k], value[flow[has]]
            value[flow[has]] = np.where(np.isnan(old), x, PAST * old + (1 - PAST) * x)
        for i in np.flatnonzero(sizes > 64).tolist():
            now = float(value[flow[i]])
            for x in ms[begin[i] + 64 : begin[i] + sizes[i]].tolist():
                now = PAST * now + (1 - PAST) * x
            value[flow[i]] = now

    def _plainly(self, f: int) -> Flow:
        a, b = int(self.heads[f]), int(self.heads[f + 1]) if f + 1 < self.flows else self.n
        flow = self.carried if f == 0 and self.carried is not None else Flow()
        for row in zip(*(x[a:b].tolist() for x in self.rows)):
            flow.take(*row)
        return flow

    def carry(self) -> Flow:
        """The last flow, to go on with."""
        f = self.flows - 1
        if f in self.redone:
            return self.redone[f]
        flow = Flow()
        state = int(self.state[f])
        flow.state, flow.closed_sides = _NAMES[state // 4], {s for s in (0, 1) if state >> s & 1}
        flow.client = None if self.client[f] < 0 else _SIDES[self.client[f]]
        for c, x in self.counts.items():
            setattr(flow, c, int(x[f]))
        for c, x in self.times.items():
            setattr(flow, c, None if np.isnan(x[f]) else float(x[f]))
        for side in (0, 1):
            line = 2 * f + side
            last = lambda lines: int(np.searchsorted(lines, line, side="right")) - 1
            if (i := last(self.tops[0])) >= 0 and self.tops[0][i] == line:
                flow.top[side] = int(self.tops[1][i] % _WRAP)
            if (i := last(self.acks[0])) >= 0 and self.acks[0][i] == line:
                flow.acked[side] = int(self.acks[2][i])
            a, b = np.searchsorted(self.ends[0], [line, line + 1])
            if (i := last(self.popped[0])) >= 0 and self.popped[0][i] == line:
                a = max(int(a), int(self.popped[1][: i + 1][self.popped[0][: i + 1] == line].max()))
            a = max(int(a), int(b) - IN_FLIGHT)
            flow.waiting[side].extend(zip((self.ends[1][a:b] % _WRAP).tolist(), self.ends[2][a:b].tolist()))
        return flow

    def results(self, n: int) -> list[pa.Array]:
        """Columns of RESULT for the first n flows."""
        for f, flow in self.redone.items():
            self.state[f], self.client[f] = _code(flow), -1 if flow.client is None else _SIDES.index(flow.client)
            for c, x in self.counts.items():
                x[f] = getattr(flow, c)
            for c, x in self.times.items():
                x[f] = np.nan if getattr(flow, c) is None else getattr(flow, c)
        names = pa.array(_NAMES).take(pa.array(self.state[:n] // 4))
        client = pa.array(_SIDES).take(pa.array(self.client[:n], mask=self.client[:n] < 0))
        count = lambda c: pa.array(self.counts[c][:n])
        time = lambda c: pa.array(self.times[c][:n], mask=np.isnan(self.times[c][:n]))
        return [names, client, count("retransmissions"), count("out_of_order"), time("last"), time("least"), time("smooth"), count("samples")]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column differs from the row before; the first row does."""
    a, b = column[1:], column[:-1]
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], np.asarray(differ)]) if len(column) else np.empty(0, bool)


def _arrays(table: pa.RecordBatch, first: int) -> list[np.ndarray]:
    out = []
    for i, name in enumerate(COLUMNS):
        column = table.column(first + i)
        flag = pa.types.is_boolean(column.type)
        values = column.fill_null(False if flag else 0).to_numpy(zero_copy_only=False)
        out.append(values.astype(np.int64) if name == "a_to_b" or not flag else values)
    return out


def tcp_flows(packets: DataFrame, *more_keys: str) -> DataFrame:
    """One row a TCP flow (or a flow's life, with "instance" as a further key) with the columns of RESULT.
    packets: keyed rows with frame_no, ts_us, a_to_b, syn, ack, fin, rst, seq, ack_no, seq_len. Rows are dealt by
    flow and sorted; tasks stream through them."""
    key = [*KEY, *more_keys]
    rows = packets.filter("protocol = 'tcp'").select(*key, *(F.col(c).alias(f"__{c}") for c in ("frame_no", *COLUMNS)))
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key), *(f"{c} {t}" for c, t in RESULT.items())])
    k = len(key)

    def run(batches):
        carried, own = None, None  # the last flow of the rows so far, and its key

        def done(keys, values):
            return pa.RecordBatch.from_arrays([*keys, *values], names=[*key, *RESULT])

        def compute(held):
            nonlocal carried, own
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            starts = np.logical_or.reduce([_changes(table.column(i)) for i in range(k)])
            goes_on = own is not None and all(table.column(i)[0].as_py() == own[i][0].as_py() for i in range(k))
            if own is not None and not goes_on:
                yield done(own, [pa.array([x], t) for x, t in zip(carried.result(), _TYPES)])
            heads = np.flatnonzero(starts)
            batch = Batch(_arrays(table, k + 1), heads, carried if goes_on else None)
            if len(heads) > 1:
                at = pa.array(heads[:-1])
                yield done([table.column(i).take(at) for i in range(k)], batch.results(len(heads) - 1))
            carried, own = batch.carry(), [table.column(i).slice(int(heads[-1]), 1) for i in range(k)]

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= TOGETHER:
                yield from compute(held)
                held, size = [], 0
        if held:
            yield from compute(held)
        if own is not None:
            yield done(own, [pa.array([x], t) for x, t in zip(carried.result(), _TYPES)])

    return rows.repartition(*key).sortWithinPartitions(*key, "__frame_no", "__ts_us").mapInArrow(run, schema)


_TYPES = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t] for t in RESULT.values()]
