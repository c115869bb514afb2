"""When idle flows are looked for: the chain of frames each of which is the first whose watermark is at least an
interval past the last one's.

Where the chain leaves a slot of time depends only on where it enters it: a chain that was last seen before a slot
enters it at the first mark at or after that plus the interval, so only the marks of the slot's first interval, and
the one behind them, can be entered. A slot's jump map is a step function: for an entry up to bounds[i], the chain asks
for exits[i] next. Maps compose. So the chain is found in parallel:

1. Tasks make the map of every slot.
2. Tasks compose the maps of GROUP slots that follow each other.
3. One task walks through the groups with a single number and tells where each is entered. It sees a row every
   SLOTS * GROUP intervals of the capture's time, however many frames there are.
4. Tasks walk through the slots of their group, and then through the marks of their slot.

Chains from different entries meet quickly, so maps are short; no map has more steps than marks in an interval.
A task holds one slot's marks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sources.tables import cut

#: Intervals in a slot, slots in a group.
SLOTS, GROUP = 16, 1024
_FIRST = -(1 << 62)


def jumps(slots: np.ndarray, marks: np.ndarray, every: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maps of whole slots, one after another: the slot, bound and exit of every step. slots: the slot of each mark;
    both ascend."""
    n, after = len(marks), _after(slots, marks, every)
    first = np.concatenate([[True], slots[1:] != slots[:-1]])
    early = marks < slots * wide + every
    behind = ~early & (first | np.concatenate([[True], early[:-1]]))  # the first mark that no entry passes
    entered = np.flatnonzero(early | behind)
    now = entered
    while (goes_on := after[now] < n).any():
        now = np.where(goes_on, after[np.minimum(now, n - 1)], now)
    return _short(slots[entered], marks[entered], marks[now] + every)


def _after(slots: np.ndarray, marks: np.ndarray, every: int) -> np.ndarray:
    """The next mark that the chain takes in the same slot, as an index; the number of marks for none."""
    after = np.searchsorted(marks, marks + every)
    ends = np.searchsorted(slots, slots, side="right")
    return np.where(after < ends, after, len(marks))


def _short(slots: np.ndarray, bounds: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    last = np.append((exits[1:] != exits[:-1]) | (slots[1:] != slots[:-1]), True)
    return slots[last], bounds[last], exits[last]


def ask(entry: int, bounds: np.ndarray, exits: np.ndarray) -> int:
    """Where the chain goes on that enters at ``entry``: past a slot without a mark so late it stays as it is."""
    i = int(np.searchsorted(bounds, entry))
    return int(exits[i]) if i < len(bounds) else entry


def compose(first: tuple, then: tuple, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of both, for entries below limit; limit is before all that ``then`` knows."""
    bounds, exits = first
    at = np.searchsorted(then[0], exits)
    through = np.where(at < len(then[0]), then[1][np.minimum(at, len(then[0]) - 1)], exits)
    if bounds[-1] < limit:  # some entries pass over the first
        bounds, through = np.append(bounds, then[0][0]), np.append(through, then[1][0])
    return _short(np.zeros(len(bounds)), bounds, through)[1:]


#: Rows that are computed together, at least, but at the end.
TOGETHER = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first column, in batches that end where it changes."""
    held, size, enough = [], 0, TOGETHER

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            rows = joined()
            keys = np.asarray(rows.column(0))
            at = int(np.searchsorted(keys, keys[-1]))
            if at:
                yield rows.slice(0, at)
            held, size = [rows.slice(at)], len(keys) - at
            enough = TOGETHER + 2 * size
    if held:
        yield joined()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges and values of a list column."""
    return np.asarray(column.offsets), np.asarray(column.values)


_MAP = "bounds array<long>, exits array<long>"


def _map_rows(name: str, keys: np.ndarray, bounds: np.ndarray, exits: np.ndarray) -> pa.RecordBatch:
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    offsets = pa.array(edges, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(keys[edges[:-1]]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (bounds, exits))], names=[name, "bounds", "exits"])


def sweeps(frames: DataFrame, every_us: int = 1_000_000) -> DataFrame:
    """frame_no and sweep_us, the watermark, of the frames after which idle flows are looked for: the first, then each
    whose watermark is at least every_us past the last sweep's. frames: frame_no, watermark_us."""
    every = max(every_us, 1)
    wide = SLOTS * every
    slot = F.floor(F.col("watermark_us") / wide).alias("slot")
    # Only frames that raise the watermark matter.
    rising = cut(frames.groupBy("watermark_us").agg(F.min("frame_no").alias("frame_no")).select(slot, "watermark_us", "frame_no"), "rising")

    def slot_maps(batches):
        for batch in _whole(batches):
            yield _map_rows("slot", *jumps(np.asarray(batch.column(0)), np.asarray(batch.column(1)), every, wide))

    def group_maps(batches):
        for batch in _whole(batches):
            groups, (edges, bounds), (_, exits) = np.asarray(batch.column(0)), _lists(batch.column(2)), _lists(batch.column(3))
            found, keys = [], []
            for i in range(len(groups)):
                one, limit = (bounds[edges[i] : edges[i + 1]], exits[edges[i] : edges[i + 1]]), int(groups[i]) * GROUP * wide + every
                if not keys or groups[i] != keys[-1]:
                    n = int(np.searchsorted(one[0], limit)) + 1
                    found.append((one[0][:n], one[1][:n]))
                    keys.append(int(groups[i]))
                else:
                    found[-1] = compose(found[-1], one, limit)
            yield _map_rows("group", np.repeat(keys, [len(b) for b, _ in found]), *(np.concatenate(x) for x in zip(*found)))

    def walk_groups(batches):
        entry = _FIRST
        for batch in batches:
            found, (edges, bounds), (_, exits) = [], _lists(batch.column(1)), _lists(batch.column(2))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found.append(entry)
                entry = ask(entry, bounds[a:b], exits[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["group", "entry"])

    def walk_slots(batches):
        for batch in _whole(batches):
            slots, entries, (edges, bounds), (_, exits) = batch.column(1), batch.column(2).to_pylist(), _lists(batch.column(3)), _lists(batch.column(4))
            entry, found, edges = None, [], edges.tolist()
            for i, given in enumerate(entries):
                if given is not None:  # a group begins
                    entry = given
                else:
                    found.append(entry)
                    entry = ask(entry, bounds[edges[i] : edges[i + 1]], exits[edges[i] : edges[i + 1]])
            yield pa.RecordBatch.from_arrays([slots.drop_null(), pa.array(found, pa.int64())], names=["slot", "entry"])

    def walk_marks(batches):
        for batch in _whole(batches):
            given = np.asarray(batch.column(3).is_valid())  # a slot begins
            entries = np.asarray(batch.column(3).drop_null())
            rows = batch.filter(pa.array(~given))
            slots, marks = np.asarray(rows.column(0)), np.asarray(rows.column(1))
            ends = np.searchsorted(slots, np.asarray(batch.column(0))[given], side="right")
            at = np.searchsorted(marks, entries)
            after, found, at = _after(slots, marks, every), [], at[at < ends]
            while len(at):  # a step in every slot
                found.append(at)
                at = after[at]
                at = at[at < len(marks)]
            if found:
                chosen = pa.array(np.sort(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([rows.column(2).take(chosen), rows.column(1).take(chosen)], names=["frame_no", "sweep_us"])

    maps = rising.select("slot", "watermark_us").repartition("slot").sortWithinPartitions("slot", "watermark_us").mapInArrow(slot_maps, f"slot long, {_MAP}")
    maps = cut(maps.select(F.floor(F.col("slot") / GROUP).alias("group"), "slot", "bounds", "exits"), "maps")
    groups = maps.repartition("group").sortWithinPartitions("group", "slot").mapInArrow(group_maps, f"group long, {_MAP}")
    entered = groups.repartition(1).sortWithinPartitions("group").mapInArrow(walk_groups, "group long, entry long")
    none = F.lit(None)
    lined = entered.select("group", none.cast("long").alias("slot"), "entry", *(none.cast("array<long>").alias(c) for c in ("bounds", "exits")))
    lined = lined.unionByName(maps.select("group", "slot", none.cast("long").alias("entry"), "bounds", "exits"))
    in_slots = lined.repartition("group").sortWithinPartitions("group", F.asc_nulls_first("slot")).mapInArrow(walk_slots, "slot long, entry long")
    lined = in_slots.select("slot", none.cast("long").alias("watermark_us"), none.cast("long").alias("frame_no"), "entry").unionByName(rising.withColumn("entry", none.cast("long")))
    return lined.repartition("slot").sortWithinPartitions("slot", F.asc_nulls_first("watermark_us")).mapInArrow(walk_marks, "frame_no long, sweep_us long")
