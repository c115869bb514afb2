"""Capture files: frames from files, files from frames.

Batches read by byte ranges (captures.py). Streams read whole files as they appear, through Spark's binaryFile
reader: a file is one row of at most 2 GiB there, which is how rotated captures come. Writing goes through a data source
whose tasks stream into files of their own; a file appears under its name only when the job commits.
"""

from __future__ import annotations

import re
import struct
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tracelake.sources import captures
from tracelake.sources.captures import HEADER, MICRO, RECORD


def _read(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield from captures.whole(name, memoryview(content.as_buffer()))


def stream_pcap(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the frames of the capture files that appear in folder. Files must appear whole; file_no
    numbers the frames of a file, there is no number over all files. Unread files wait, none are dropped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = files.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.pcap").load(folder)
    rows = found.select("path", "content").mapInArrow(_read, captures.SCHEMA)
    return rows.select("source", (F.col("place") + 1).alias("file_no"), *(c for c, _ in captures.FRAME))


def read_pcap(spark: SparkSession, path: str | list[str], then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Frames of the capture files, with frame_no from 1 on in the order of paths, then of records. An empty file
    list raises Spark's own error; a capture without records gives no rows. See read_captures for ``then``."""
    return captures.read_captures(spark, path, then)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PcapSink(DataSource):
    """Sink ``capture``: options path, link_type (1), snaplen (65535), rotate_bytes (0: one file a task),
    keep (0: all files, else the newest so many)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return PcapWriter(self.options)


NUMBERED = re.compile(r"part-(\d+)\.pcap")


class PcapWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.link, self.snaplen, self.limit = (int(options.get(k, d)) for k, d in (("link_type", 1), ("snaplen", 65535), ("rotate_bytes", 0)))
        self.keep, self.job = int(options.get("keep", 0)), uuid.uuid4().hex

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, root = self._store()
        task, attempt, files, out, size = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, 0
        store.create_dir(f"{root}/_{self.job}", recursive=True)
        for row in rows:
            raw = bytes(row["raw"] or b"")[: self.snaplen]
            if out is not None and self.limit and size >= self.limit:
                out.close()
                time.sleep(0.002)  # streams take files in the order of their modification times, in milliseconds
                out = None
            if out is None:
                files.append(f"_{self.job}/{attempt}/part-{task:06d}-{len(files):06d}.pcap")
                store.create_dir(f"{root}/_{self.job}/{attempt}", recursive=True)
                out, size = store.open_output_stream(f"{root}/{files[-1]}"), 24
                out.write(struct.pack("<" + HEADER, MICRO, 2, 4, 0, 0, self.snaplen, self.link))
            out.write(struct.pack("<" + RECORD, row["ts_us"] // 1_000_000, row["ts_us"] % 1_000_000, len(raw), row["wire_len"]) + raw)
            size += 16 + len(raw)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileSelector

        store, root = self._store()
        names = {f.rpartition("/")[2]: f for message in messages if message for f in message.files}
        found = store.get_file_info(FileSelector(root, allow_not_found=True))
        old = {int(m[1]): f.base_name for f in found if (m := NUMBERED.fullmatch(f.base_name))}
        first = max(old, default=-1) + 1
        new = dict(enumerate(sorted(names), first))
        for number in sorted([*old, *new])[: -self.keep] if self.keep else ():  # only the newest stay, of all jobs
            if number in old:
                store.delete_file(f"{root}/{old[number]}")
            else:
                del new[number]
        for number, name in new.items():
            store.move(f"{root}/{names[name]}", f"{root}/part-{number:09d}.pcap")
        store.delete_dir(f"{root}/_{self.job}")

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        store, root = self._store()
        if store.get_file_info(f"{root}/_{self.job}").type != FileType.NotFound:
            store.delete_dir(f"{root}/_{self.job}")


def write_pcap(frames: DataFrame, path: str, link_type: int = 1, rotate_bytes: int = 0, files: int | None = None, keep: int = 0) -> None:
    """Write frames (frame_no, ts_us, wire_len, raw) in frame order as part-*.pcap below path, whose names
    sort in that order. Numbers go on from those of files that are there; ``keep`` newest stay, all for 0. ``files`` fixes the number of tasks; 1 gives a single capture."""
    spark = frames.sparkSession
    spark.dataSource.register(PcapSink)
    rows = frames.select("frame_no", "ts_us", "wire_len", "raw")
    rows = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "frame_no") if files else rows.repartitionByRange("frame_no")
    rows.sortWithinPartitions("frame_no").write.format("capture").option("link_type", link_type).option("rotate_bytes", rotate_bytes).option("keep", keep).mode("append").save(path)
