"""Capture files read by byte ranges: classic PCAP and PCAPNG, each byte once but for what guesses look at.

Neither format marks places at which a file can be split. A task takes ranges that follow each other, several where they are
small. It looks for the first record header in them:
a place from which headers lead to headers, with plausible lengths and times near each other, for as far as
it looks. It then reads the records that begin in its ranges, from one into the next. That the guess was right is proved
afterwards: the ranges of a file must join, each beginning at the byte where the one before ended, the first at the file's start
and the last ending at its end. A file whose ranges don't join (a capture inside a capture can look like one; a PCAPNG
file can declare an interface in its middle) is read again, by ranges whose beginnings one task finds by going
from header to header.

Frame numbers come from the number of frames of the ranges before, so files are numbered in the order of their
paths and are never read for that alone. Files are opened through pyarrow.fs (local or mounted folders, S3, GCS, HDFS);
Spark lists them and passes over files of no bytes. A file that is no capture, or ends inside a record, raises
ValueError.
"""

from __future__ import annotations

import contextlib
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.tables import cut

# Fixed values of the formats.
MICRO, NANO = 0xA1B2C3D4, 0xA1B23C4D
HEADER, RECORD = "IHHiIII", "IIII"
SECTION, INTERFACE, PACKET, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 2, 3, 6
BYTE_ORDER = 0x1A2B3C4D
RESOLUTION, OFFSET = 9, 14
#: Blocks that a PCAPNG file is expected to have: those above, names, statistics, journal, secrets, custom blocks.
BLOCKS = (SECTION, INTERFACE, PACKET, SIMPLE, 4, 5, ENHANCED, 9, 10, 0xBAD, 0x40000BAD)
#: The longest frame that a guess believes in.
LONGEST = 262_144
#: Seconds between neighbouring records that a guess believes in.
NEAR = 86_400
#: Bytes of a range, and of a task's small ranges at most; bytes that a guess looks at together; bytes read at a time; bytes
#: read beyond a range, in case its last record reaches there; frames and bytes handed on at a time.
RANGE_BYTES, LOOK_BYTES, READ_BYTES, OVER_BYTES, ROWS, BATCH_BYTES = 32 << 20, 1 << 20, 8 << 20, 4096, 8192, 16 << 20
#: Tasks a core over all files, before ranges are read several a task.
TASKS = 4

FRAME = [("ts_sec", "long"), ("ts_usec", "int"), ("ts_us", "long"), ("wire_len", "long"), ("cap_len", "int"), ("link_type", "int"), ("raw", "binary")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_RANGED = [("source", "string"), ("range_no", "long"), ("place", "long"), ("begin", "long"), ("end", "long"), *FRAME]

SCHEMA = ", ".join(f"{c} {t}" for c, t in _RANGED)


def _u32(data: np.ndarray, order: str) -> np.ndarray:
    """The 32-bit number from each byte on."""
    return np.lib.stride_tricks.as_strided(data[: len(data) - 3], (len(data) - 3, 4), (1, 1)).copy().view(order + "u4").ravel()


class Classic:
    """Records of a classic PCAP file. A record: [begin, end) of it, seconds, microseconds, wire length, [from, to)
    of its bytes, link type; places are relative to the bytes given."""

    first, head = 24, 16
    open = False

    def __init__(self, start: bytes, name: str):
        if len(start) < 24:
            raise ValueError(f"{name}: no PCAP header")
        order = next((o for o in "<>" if struct.unpack_from(o + "I", start)[0] in (MICRO, NANO)), None)
        if order is None:
            raise ValueError(f"{name}: not a capture file")
        magic, *_, link = struct.unpack_from(order + HEADER, start)
        self.name, self.order, self.link, self.scale, self.record = name, order, link & 0xFFFF, 1000 if magic == NANO else 1, struct.Struct(order + RECORD)

    def state(self) -> None:
        return None

    def headers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte the size of the record if a header began there, 0 where none can; and its time in seconds."""
        numbers = _u32(data, self.order)
        n = len(numbers) - 12
        seconds, fraction, captured, wire = (numbers[k : k + n] for k in (0, 4, 8, 12))
        good = (captured <= LONGEST) & (captured <= wire) & (fraction < 1_000_000 * self.scale) & (wire > 0)
        return np.where(good, captured.astype(np.int64) + 16, 0), seconds.astype(np.int64)

    def parse(self, data: memoryview, limit: int) -> tuple[list[tuple], int, bool]:
        """Whole records that begin before ``limit``; where the next begins; whether reading must stop there."""
        found, at, n, unpack, scale, link = [], 0, len(data), self.record.unpack_from, self.scale, self.link
        while at < limit and at + 16 <= n:
            seconds, fraction, captured, wire = unpack(data, at)
            end = at + 16 + captured
            if end > n:
                break
            found.append((at, end, seconds, fraction // scale, wire, at + 16, end, link))
            at = end
        return found, at, False


class NextGeneration:
    """Blocks of a PCAPNG file, as records; blocks without a packet belong to the record after them."""

    first, head = 0, 12

    def __init__(self, start: bytes, name: str):
        if len(start) < 12 or struct.unpack_from("<I", start)[0] != SECTION:
            raise ValueError(f"{name}: not a capture file")
        self.name, self.order, self.interfaces = name, "", []
        self._section(start)
        #: Whether blocks that change what packets mean may come after the first packet.
        self.open = True
        self.packets = False

    def _section(self, block: bytes | memoryview) -> None:
        order = next((o for o in "<>" if struct.unpack_from(o + "I", block, 8)[0] == BYTE_ORDER), None)
        if order is None or (self.order and order != self.order):
            raise ValueError(f"{self.name}: bad byte order of a section")
        self.order, self.interfaces = order, []

    def _interface(self, block: memoryview) -> None:
        link, _, snap = struct.unpack_from(self.order + "HHI", block, 8)
        if self.interfaces and link != self.interfaces[0][0]:
            raise ValueError(f"{self.name}: interfaces of different link types")
        units, shift, at = 10**6, 0, 16
        while at + 4 <= len(block) - 4:
            code, size = struct.unpack_from(self.order + "HH", block, at)
            if code == 0:
                break
            if code == RESOLUTION and size >= 1:
                told = block[at + 4]
                units = 1 << (told & 0x7F) if told & 0x80 else 10**told
            elif code == OFFSET and size >= 8:
                shift = struct.unpack_from(self.order + "q", block, at + 4)[0]
            at += 4 + (size + 3 & ~3)
        self.interfaces.append((link, snap, units, shift))

    def state(self) -> list:
        return list(self.interfaces)

    def headers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers = _u32(data, self.order)
        n = max(len(numbers) - 8, 0)
        size = numbers[4 : 4 + n].astype(np.int64)
        good = np.isin(numbers[:n], BLOCKS) & (size >= 12) & (size % 4 == 0) & (size <= LONGEST + 1024)
        last = np.arange(n) + size - 4
        inside = good & (last < len(numbers))
        good[inside] &= numbers[last[inside]] == size[inside]
        return np.where(good, size, 0), np.zeros(n, np.int64)

    def parse(self, data: memoryview, limit: int) -> tuple[list[tuple], int, bool]:
        found, at, n, begin = [], 0, len(data), 0
        while at < limit and at + 12 <= n:
            kind, size = struct.unpack_from(self.order + "II", data, at)
            if kind == SECTION and struct.unpack_from("<I" if self.order == ">" else ">I", data, at + 8)[0] == BYTE_ORDER:
                raise ValueError(f"{self.name}: sections of different byte orders")
            if size < 12 or size % 4:
                raise ValueError(f"{self.name}: bad block length")
            end = at + size
            if end > n:
                break
            if struct.unpack_from(self.order + "I", data, end - 4)[0] != size:
                raise ValueError(f"{self.name}: block lengths differ")
            if kind in (SECTION, INTERFACE):
                if self.packets and not self.open:
                    return self._closed(found, begin, at), at, True
                block = data[at:end]
                if kind == SECTION:
                    self._section(block)
                else:
                    self._interface(block)
            elif kind in (PACKET, SIMPLE, ENHANCED):
                self.packets = True
                found.append((begin, end, *self._packet(kind, data, at, end)))
                begin = end
            at = end
        return self._closed(found, begin, at), at, False

    @staticmethod
    def _closed(found: list[tuple], begin: int, at: int) -> list[tuple]:
        """Blocks after the last packet belong to it."""
        if found and begin < at:
            found[-1] = (found[-1][0], at, *found[-1][2:])
        return found

    def _packet(self, kind: int, data: memoryview, at: int, end: int) -> tuple:
        if kind == SIMPLE:
            number, ticks, wire, body = 0, None, struct.unpack_from(self.order + "I", data, at + 8)[0], at + 12
            captured = None
        else:
            form, skip = ("IIIII", 28) if kind == ENHANCED else ("HHIIII", 28)
            number, *rest = struct.unpack_from(self.order + form, data, at + 8)
            high, low, captured, wire = rest[-4:]
            ticks, body = high << 32 | low, at + skip
        if number >= len(self.interfaces):
            raise ValueError(f"{self.name}: packet of an unknown interface")
        link, snap, units, shift = self.interfaces[number]
        if captured is None:
            captured = min(wire, snap or wire, end - 4 - body)
        if body + captured > end - 4:
            raise ValueError(f"{self.name}: packet longer than its block")
        seconds, rest = divmod(ticks or 0, units)
        return seconds + (shift if ticks is not None else 0), rest * 1_000_000 // units, wire, body, body + captured, link


def form_of(start: bytes, name: str):
    """The reader of the format that a file's first bytes tell."""
    if len(start) >= 12 and struct.unpack_from("<I", start)[0] == SECTION:
        return NextGeneration(start, name)
    return Classic(start, name)


def opened(uri: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:"):  # Spark does not escape what it lists
        return LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    store, path = FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def guess(form, read: Callable[[int, int], bytes], begin: int, end: int, size: int) -> int | None:
    """Where the first record in [begin, end) begins: the first place from which headers lead to headers to the end
    of what is looked at, or of the file. None, if there is no such place."""
    step = 4 if isinstance(form, NextGeneration) else 1
    at = begin + -begin % step
    while at < end:
        data = np.frombuffer(read(at, LOOK_BYTES + LONGEST + 2048), np.uint8)
        if len(data) < 28:
            return None
        jump, seconds = form.headers(data)
        n, whole = len(jump), at + len(data) == size
        place = np.arange(0, min(n, LOOK_BYTES, end - at), step)
        start, live = place[jump[place] > 0], None
        live = start.copy()
        alive = np.ones(len(start), bool)
        steps = 0
        while len(start) and steps < LOOK_BYTES:
            steps += 1
            ahead = live + jump[np.minimum(live, n - 1)]
            inside = ahead < n
            # Past the last place where a header fits a chain holds if the file ends just there, or goes on unseen.
            good = np.where(inside, jump[np.minimum(ahead, n - 1)] > 0, (not whole) | (ahead == len(data)))
            now, then = seconds[np.minimum(live, n - 1)], seconds[np.minimum(ahead, n - 1)]
            good &= ~inside | (np.abs(then - now) <= NEAR)
            alive &= good
            if alive.any() and not inside[np.argmax(alive)]:  # the first chain that holds has gone all the way
                return at + int(start[np.argmax(alive)])
            start, live, alive = start[alive], np.where(inside, ahead, live)[alive], alive[alive]
        at += LOOK_BYTES
    return None


def _reader(file):
    return lambda at, n: file.read_at(n, at)


def _batches(form, read, at: int, stop: int, size: int) -> Iterator[list[tuple]]:
    """Records that begin in [at, stop), with absolute begin and end, and their bytes."""
    want, edge = READ_BYTES, at
    while at < stop:
        data = memoryview(read(at, min(want, stop - at + OVER_BYTES) if want == READ_BYTES else want))
        found, used, ended = form.parse(data, stop - at)
        if not used and not ended:
            if at + len(data) >= size:
                raise ValueError(f"{form.name}: truncated record at byte {at}")
            want *= 2
            continue
        if found:
            rows = [(edge if i == 0 else at + r[0], at + r[1], *r[2:5], data[r[5] : r[6]], r[7]) for i, r in enumerate(found)]
            edge = rows[-1][1]
            yield rows
        at, want = at + used, READ_BYTES
        if ended:
            return


def _by_range(rows: list[tuple], begin: int, number: int, range_bytes: int) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows that begin in the same range; the first range is ``number`` and begins at ``begin``."""
    of = lambda r: number + (r[0] - begin) // range_bytes
    for own, run in itertools.groupby(rows, of):
        yield own, list(run)


def _arrow(name: str, number: int, first: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    i = 0
    while i < len(rows):
        j, held = i, 0
        while j < len(rows) and j - i < ROWS and (j == i or held < BATCH_BYTES):
            held += len(rows[j][5])
            j += 1
        begin, end, sec, usec, wire, raw, link = zip(*rows[i:j])
        sec, usec, n = np.array(sec, np.int64), np.array(usec, np.int64), j - i
        columns = [[name] * n, np.full(n, number), np.arange(first + i, first + j), begin, end, sec, usec, sec * 1_000_000 + usec, wire, [len(x) for x in raw], link, [x.tobytes() for x in raw]]
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, _RANGED)], names=[c for c, _ in _RANGED])
        i = j


def whole(name: str, content: memoryview) -> Iterator[pa.RecordBatch]:
    """Frames of a file in memory, in batches of _RANGED."""
    read = lambda at, n: content[at : at + n]
    form, place = form_of(bytes(content[:64]), name), 0
    for rows in _batches(form, read, form.first, len(content), len(content)):
        yield from _arrow(name, 0, place, rows)
        place += len(rows)


def _scan(spark: SparkSession, shares: list[tuple[str, int, int, int, int, int | None, list | None]], range_bytes: int) -> DataFrame:
    """Frames of (path, size, first range, begin, end, exact start or None, state), a task each. Without an exact start the
    first record is guessed, and a PCAPNG file is read up to where an interface or section is declared late."""

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                path, size, first, begin, end, start, state = shares[number]
                with opened(path) as file:
                    read = _reader(file)
                    form = form_of(read(0, 64), path)
                    if isinstance(form, NextGeneration):
                        form.open = start is not None or (begin == 0 and end >= size)
                        if state is not None:
                            form.interfaces = [tuple(x) for x in state]
                        elif begin > 0:  # what is declared before the first packet
                            _declared(form, read, size)
                    at = form.first if begin == 0 else start if start is not None else guess(form, read, begin, end, size)
                    now, place = first, 0
                    # What fails behind a guess fails again where the start is known, or the guess was wrong.
                    bear = contextlib.suppress(ValueError) if start is None and begin > 0 else contextlib.nullcontext()
                    with bear:
                        for rows in _batches(form, read, at, end, size) if at is not None else ():
                            for own, part in _by_range(rows, begin, first, range_bytes):
                                now, place = own, place if own == now else 0
                                yield from _arrow(path, own, place, part)
                                place += len(part)

    return spark.range(0, len(shares), 1, max(len(shares), 1)).mapInArrow(run, SCHEMA)


def _declared(form: NextGeneration, read, size: int) -> None:
    """Reads the interfaces that the head of the file declares, up to its first packet."""
    at, want = 0, 1 << 16
    form.packets, form.interfaces = False, []
    while at < size:
        data = memoryview(read(at, want))
        if len(data) < 12:
            break
        kind, length = struct.unpack_from(form.order + "II", data)
        if kind in (PACKET, SIMPLE, ENHANCED) or length < 12:
            break
        if length > len(data):
            if at + len(data) >= size:
                break
            want = length
            continue
        form.parse(data[:length], length)
        at, want = at + length, 1 << 16
    form.packets = True


def _indexed(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> dict[tuple[str, int], tuple[int | None, list | None]]:
    """Exact starts of ranges, and what was declared before them, by going from header to header: a task a file."""

    def run(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                path, size = files[number]
                out = []
                with opened(path) as file:
                    read = _reader(file)
                    form = form_of(read(0, 64), path)
                    form.open, at, edge = True, form.first, range_bytes
                    while at < size:
                        data = memoryview(read(at, READ_BYTES))
                        while edge <= at:  # the first record at or after the edge begins here
                            out.append((path, edge, at, repr(form.state())))
                            edge += range_bytes
                        # Stop before the first record behind the next edge, with the state of that place.
                        _, used, _ = form.parse(data, min(len(data), edge - at))
                        if not used:
                            more = READ_BYTES
                            while not used:
                                if at + more >= size:
                                    raise ValueError(f"{path}: truncated record at byte {at}")
                                more *= 2
                                _, used, _ = form.parse(memoryview(read(at, more)), edge - at)
                        at += used
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3])], names=["source", "edge", "start", "state"])

    import ast

    rows = spark.range(0, len(files), 1, len(files)).mapInArrow(run, "source string, edge long, start long, state string").collect()  # a row a range of these files
    return {(r.source, r.edge): (r.start, ast.literal_eval(r.state)) for r in rows}


def _together(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> int:
    """How many ranges a task takes: one, unless they are small and there are far more of them than cores."""
    size = min(RANGE_BYTES, sum(size for _, size in files) // (TASKS * spark.sparkContext.defaultParallelism))
    return max(size // range_bytes, 1)


def _shares(files: list[tuple[str, int]], range_bytes: int, together: int, exact: dict | None = None) -> list[tuple]:
    """Shares of ``together`` ranges; ranges are numbered over all files."""
    out, number, wide = [], 0, range_bytes * together
    for path, size in files:
        for begin in range(0, max(size, 1), wide):
            end, first = min(begin + wide, size), number + begin // range_bytes
            if exact is None or begin == 0:
                out.append((path, size, first, begin, max(end, 1), None if exact is None else 0, None))
            elif (path, begin) in exact and exact[path, begin][0] < end:
                out.append((path, size, first, begin, end, *exact[path, begin]))
        number += -(-max(size, 1) // range_bytes)
    return out


def _torn(table: DataFrame, files: dict[str, int]) -> list[str]:
    """Those of files whose ranges don't join."""
    per_range = table.groupBy("source", "range_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    order = Window.partitionBy("source").orderBy("range_no")
    joined = per_range.withColumn("joins", F.col("begin") == F.coalesce(F.lag("end").over(order), F.col("begin")))
    told = joined.groupBy("source").agg(F.min("begin").alias("first"), F.max("end").alias("last"), F.min("joins").alias("joins")).collect()  # a row a file
    fine = {r.source for r in told if r.joins and r.first <= 24 and r.last == files.get(r.source)}
    return sorted(files.keys() - fine)


def read_captures(spark: SparkSession, path: str | list[str], then: Callable[[DataFrame], DataFrame] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of the files with source, frame_no, file_no (the number in the file) and the columns of a frame. They are
    kept as a table in the shared folder; ``then``, which must keep all rows and the columns source, range_no, place, begin and end, is
    applied before that, so decoded columns are written at once. An empty list of files raises Spark's own error."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row a file, as Spark itself lists them
    files = sorted((r.path, r.length) for r in listed)
    apply = then or (lambda frames: frames)
    together = _together(spark, files, range_bytes)
    table = cut(apply(_scan(spark, _shares(files, range_bytes, together), range_bytes)), "frames")
    several = {p: n for p, n in files if n > range_bytes}
    torn = _torn(table.filter(F.col("source").isin(list(several))) if len(several) < 1000 else table, several) if several else []
    if torn:
        again = [(p, several[p]) for p in torn]
        exact = cut(apply(_scan(spark, _shares(again, range_bytes, together, _indexed(spark, again, range_bytes * together)), range_bytes)), "frames")
        table = table.filter(~F.col("source").isin(torn)).unionByName(exact)
    counts = table.groupBy("source", "range_no").agg(F.count("*").alias("n"))
    # One row a range, so a single task is enough for the running totals.
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("source", "range_no", before(Window.orderBy("source", "range_no")).alias("ahead"), before(Window.partitionBy("source").orderBy("range_no")).alias("inside"))
    known = table.join(cut(firsts, "ranges"), ["source", "range_no"])
    return known.withColumns({"frame_no": F.col("ahead") + F.col("place") + 1, "file_no": F.col("inside") + F.col("place") + 1}).drop("ahead", "inside", "range_no", "place", "begin", "end")
