"""Captures read by ranges: cuts at every place, misleading bytes, PCAPNG, frame numbers, torn guesses."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.functions.decode import decode
from tracelake.sources import captures


def classic(frames, order="<", nano=False, snaplen=65535):
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, 1)]
    for ts, raw, wire in frames:
        out.append(struct.pack(order + "IIII", ts // 1_000_000, ts % 1_000_000 * (1000 if nano else 1), len(raw), wire) + raw)
    return b"".join(out)


def block(kind, body, order="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link=1, options=b"", order="<"):
    return block(1, struct.pack(order + "HHI", link, 0, 65535) + options, order)


def enhanced(ts, raw, wire, order="<", number=0):
    return block(6, struct.pack(order + "IIIII", number, ts >> 32, ts & 0xFFFFFFFF, len(raw), wire) + raw, order)


def some_frames(seed, n, most=120):
    r, now, out = random.Random(seed), 1_700_000_000_000_000, []
    for _ in range(n):
        now += r.randrange(5000)
        raw = r.randbytes(r.choice((0, 1, 20, r.randrange(most))))
        out.append((now, raw, len(raw) + r.choice((0, 0, 40)) + (not raw)))
    return out


def told(df):
    return [(r.file_no, r.ts_us, bytes(r.raw), r.wire_len) for r in df.orderBy("frame_no").collect()]


def wanted(frames):
    return [(i, *f) for i, f in enumerate(frames, 1)]


@pytest.mark.parametrize("order,nano", [("<", False), (">", True)])
def test_every_guess_is_the_first_record(order, nano):
    content = classic(some_frames(1, 60), order, nano)
    form = captures.form_of(content[:64], "x")
    starts = [24]
    while starts[-1] < len(content):
        starts.append(starts[-1] + 16 + struct.unpack_from(order + "I", content, starts[-1] + 8)[0])
    read = lambda at, n: content[at : at + n]
    for begin in range(24, len(content)):
        want = next(s for s in starts if s >= begin)
        assert captures.guess(form, read, begin, len(content), len(content)) == (want if want < len(content) else None)


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_ranges_equal_the_whole(spark, tmp_path, size):
    parts = [some_frames(k, n) for k, n in ((1, 300), (2, 0), (3, 1), (4, 200))]
    for k, frames in enumerate(parts):
        (tmp_path / f"part {k}.pcap").write_bytes(classic(frames, "<>"[k % 2], k == 3))
    got = captures.read_captures(spark, str(tmp_path), range_bytes=size)
    assert told(got) == [x for frames in parts for x in wanted(frames)]
    assert sorted(r.frame_no for r in got.collect()) == list(range(1, 502))
    assert [len(b) for b in captures.whole("x", memoryview(classic(parts[0])))] == [300]


def test_captures_inside_captures(spark, tmp_path):
    """Payloads that are records themselves: guesses may follow them, the joints tell, and the file is read again."""
    inner = classic(some_frames(5, 400, 30))[24:]
    frames = [(1_700_000_000_000_000 + i, inner[: 8000 + i], 8000 + i) for i in range(12)]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    (tmp_path / "b.pcap").write_bytes(classic(some_frames(6, 100)))
    assert told(captures.read_captures(spark, str(tmp_path), range_bytes=1500)) == wanted(frames) + wanted(some_frames(6, 100))


def test_giant_records_and_far_times(spark, tmp_path):
    """Ranges in which no record begins, and neighbours that are years apart."""
    frames = [(1_000_000, b"a" * 9000, 9000), (1_700_000_000_000_000, b"b", 1), (5_000_000, bytes(7000), 7000), (6_000_000, b"", 3)]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    assert told(captures.read_captures(spark, str(tmp_path), range_bytes=1000)) == wanted(frames)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("size", [101, 5000, 1 << 20])
def test_next_generation(spark, tmp_path, order, size):
    frames = some_frames(7, 150)
    names = block(4, b"\0" * 4, order)
    body = [section(order), interface(order=order), names]
    for i, (ts, raw, wire) in enumerate(frames):
        body += [enhanced(ts, raw, wire, order), *([names, block(0xBAD, b"custom", order)] if i % 7 == 0 else [])]
    (tmp_path / "a.pcapng").write_bytes(b"".join([*body, block(5, bytes(12), order)]))
    assert told(captures.read_captures(spark, str(tmp_path), range_bytes=size)) == wanted(frames)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_interfaces_declared_late(spark, tmp_path, size):
    """A second interface with nanoseconds and an offset, then a new section with ticks of 2^-20 seconds: only reading
    from header to header knows them."""
    nano = struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HHq", 14, 8, 100) + struct.pack("<HH", 0, 0)
    binary = struct.pack("<HHB3x", 9, 1, 0x80 | 20) + struct.pack("<HH", 0, 0)
    body, want = [section(), interface()], []
    for i in range(40):
        body.append(enhanced(7_000_000 + i, b"x" * i, i + 1))
        want.append((7_000_000 + i, b"x" * i, i + 1))
    body.append(interface(options=nano))
    for i in range(40):
        body.append(enhanced(5_000_000_123 + i * 1000, b"y" * i, i + 1, number=1))
        want.append((105_000_000 + i, b"y" * i, i + 1))
    body += [section(), interface(options=binary)]
    for i in range(40):
        body.append(enhanced((9 << 20) + (1 << 19), b"z" * i, i + 1))
        want.append((9_500_000, b"z" * i, i + 1))
    body.append(block(3, struct.pack("<I", 6) + b"simple"))
    body.append(block(2, struct.pack("<HHIIII", 0, 0, 0, 3 << 20, 3, 9) + b"old"))
    want += [(0, b"simple", 6), (3_000_000, b"old", 9)]
    (tmp_path / "a.pcapng").write_bytes(b"".join(body))
    assert told(captures.read_captures(spark, str(tmp_path), range_bytes=size)) == wanted(want)


def test_damaged_files(spark, tmp_path):
    good = classic(some_frames(8, 50))
    for name, content in (("cut", good[:-3]), ("header", good + b"abc"), ("other", b"x" * 500), ("links", section() + interface(1) + interface(113) + enhanced(1, b"a", 1)),
                          ("order", section() + interface() + enhanced(1, b"a", 1) + section(">")), ("trailer", section() + interface()[:-4] + b"abcd"), ("nobody", section() + enhanced(1, b"a", 1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pcap").write_bytes(content)
        for size in (200, 1 << 20):
            with pytest.raises(Exception, match="ValueError|truncated"):
                captures.read_captures(spark, str(tmp_path / name), range_bytes=size).count()


def test_files_of_no_bytes(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"")
    (tmp_path / "b.pcap").write_bytes(classic(some_frames(8, 5)))
    assert told(captures.read_captures(spark, str(tmp_path))) == wanted(some_frames(8, 5))


def test_written_decoded(spark, tmp_path):
    frames = some_frames(9, 80)
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    got = captures.read_captures(spark, str(tmp_path), lambda rows: decode(rows.withColumn("original", F.col("raw")), "parse_error", "protocol"), 900)
    assert [bytes(r.original) for r in got.orderBy("frame_no").collect()] == [f[1] for f in frames] and "raw" not in got.columns


def test_small_ranges_share_tasks_and_reads(spark, tmp_path):
    """Many small ranges are no more tasks than cores can use, and a range reads its own bytes, not all that follow."""
    frames = some_frames(11, 3000)
    (tmp_path / "a.pcap").write_bytes(content := classic(frames))
    seen, old = [], captures._scan

    def spy(*args):
        seen.append(old(*args))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(captures, "_scan", spy)
        got = captures.read_captures(spark, str(tmp_path), range_bytes=100)
    assert told(got) == wanted(frames)
    assert seen and all(x.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism for x in seen)
    read = []
    form = captures.form_of(content[:64], "x")
    rows = list(captures._batches(form, lambda at, n: read.append(n) or content[at : at + n], 24, 1024, len(content)))
    assert sum(map(len, rows)) > 5 and sum(read) < 20_000


@pytest.mark.skipif(not os.environ.get("TRACELAKE_LARGE"), reason="writes 3 GiB")
def test_three_gigabytes(spark, tmp_path):
    raw, n = os.urandom(1400), 2_300_000
    with open(tmp_path / "a.pcap", "wb") as f:
        f.write(classic([]))
        for i in range(n // 1000):
            f.write(b"".join(struct.pack("<IIII", 1_700_000_000 + i, k, 1400, 1400) + raw for k in range(1000)))
    got = captures.read_captures(spark, str(tmp_path), lambda rows: rows.withColumn("raw", F.substring("raw", 1, 4)))
    assert got.agg(F.count("*"), F.max("frame_no"), F.count_distinct("frame_no")).first() == (n, n, n)
