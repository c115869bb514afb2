"""Rows in order for a task that needs them all, without a sort of them all in it: tasks sort ranges and write them as files,
the one task reads file after file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.sources.captures import opened
from tracelake.sources.tables import scratch

#: Rows handed on at a time.
ROWS = 1 << 14


def in_order(rows: DataFrame, order: list[str], group: str, groups: list[int], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over the rows of each of ``groups`` (whole numbers in the column ``group``), sorted by ``order``: a task a group,
    which holds a batch."""
    spark, names = rows.sparkSession, rows.columns
    at, folder = names.index(group), scratch(spark, "ordered")
    rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).write.parquet(folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect()  # a row a file
    files = sorted(r.path for r in found)  # the number of the task that wrote a file leads its name

    def read(own: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for path in files:
            with opened(path) as file:
                table = pq.ParquetFile(file)
                for i in range(table.metadata.num_row_groups):
                    told = table.metadata.row_group(i).column(at).statistics
                    if told is not None and told.has_min_max and not told.min <= own <= told.max:
                        continue
                    for batch in table.iter_batches(ROWS, [i], names):
                        batch = batch.filter(pc.equal(batch.column(at), own))
                        if batch.num_rows:
                            yield batch

    def task(batches):
        for batch in batches:
            for own in batch.column(0).to_pylist():
                yield from run(read(groups[own]))

    return spark.range(0, len(groups), 1, max(len(groups), 1)).mapInArrow(task, schema)
