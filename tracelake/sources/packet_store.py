"""Stored frames, looked up by number: the newest ``capacity`` numbers up to the largest one seen.

Frames lie in folders of BUCKET numbers each, so a look-up opens one folder, and within its files the statistics of
row groups sorted by number leave one. A folder that the window has passed goes as a whole; what is left of numbers
before the window is not found. A number that is stored again is that of the later store. Stores follow each other;
each is one Spark job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbers in a folder.
BUCKET = 1 << 16


class PacketStore:
    def __init__(self, spark: SparkSession, path: str, capacity: int, bucket: int = BUCKET):
        self.spark, self.path, self.capacity, self.bucket = spark, path.rstrip("/"), capacity, bucket

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def buckets(self) -> list[int]:
        """The folders that are there."""
        files, path = self._files()
        if not files.exists(path):
            return []
        names = (s.getPath().getName() for s in files.listStatus(path))
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("bucket="))

    def largest(self) -> int | None:
        """The largest number stored, from the last folder."""
        found = self.buckets()
        return self._rows().filter(F.col("bucket") == found[-1]).agg(F.max("frame_no")).first()[0] if found else None

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "false").parquet(self.path)

    def put(self, frames: DataFrame) -> None:
        """Stores frames (frame_no and any other columns). Those before the window that the largest number so far has
        opened are passed over; folders that the new window has passed go."""
        if self.capacity <= 0:
            return
        before = self.largest()
        rows = frames if before is None else frames.filter(F.col("frame_no") > before - self.capacity)
        rows = rows.withColumns({"stored": F.lit(time.time_ns()), "bucket": F.floor(F.col("frame_no") / self.bucket)})
        # Of numbers that are there twice any one stays; of stores the later one.
        rows = rows.dropDuplicates(["frame_no"]).repartition("bucket").sortWithinPartitions("bucket", "frame_no")
        rows.write.mode("append").partitionBy("bucket").parquet(self.path)
        self.forget()

    def forget(self) -> None:
        """Drops the folders behind the window."""
        top = self.largest()
        files, path = self._files()
        for bucket in self.buckets():
            if top is not None and (bucket + 1) * self.bucket <= top - self.capacity + 1:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}"), True)

    def get(self, numbers: list[int] | DataFrame) -> DataFrame:
        """The stored frames of these numbers (a list, or a column frame_no) that are in the window."""
        top = self.largest()
        if top is None:
            raise KeyError("nothing is stored")
        found = self._rows().filter(F.col("frame_no") > top - self.capacity)
        if isinstance(numbers, DataFrame):
            asked = numbers.select("frame_no").distinct().withColumn("bucket", F.floor(F.col("frame_no") / self.bucket))
            found = found.join(asked, ["bucket", "frame_no"], "left_semi")
        else:
            own = sorted({n // self.bucket for n in numbers})
            found = found.filter(F.col("bucket").isin(own) & F.col("frame_no").isin(list(numbers)))
        last = F.row_number().over(Window.partitionBy("frame_no").orderBy(F.desc("stored")))
        return found.withColumn("nth", last).filter("nth = 1").drop("nth", "stored", "bucket")
