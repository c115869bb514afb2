"""Weighted heavy hitters from a sketch of bounded size that can be merged.

A sketch holds at most k keys with a weight each and one number, the error. What is added is summed with what is held; if
more than k keys are left, the weight of the (k+1)-th goes off all of them, those with nothing left go, and the error
grows by it. So with total weight W, after any additions and merges in any order:

- a key's true weight is between its held weight (0 if it isn't held) and that plus the error,
- the error is at most W / (k + 1), so every key with more than that is held.

Tasks make a sketch of their rows, then sketches are merged, FAN at a time; a task's memory is k keys and a batch. What is
held is a superset of the keys above a share, so a second pass over the rows of those keys makes exact sums. The first key
column must not be null."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.flows import KEY
from tracelake.sources.tables import cut

#: Sketches that one task merges.
FAN = 64


def counters(n: int) -> int:
    """Keys held for the n largest."""
    return max(4 * n, 16)


class Sketch:
    def __init__(self, k: int):
        self.k, self.error, self.held = k, 0, None

    def add(self, sums: pd.Series, error: int = 0) -> None:
        """sums: weights by distinct keys; error: that of a sketch they come from."""
        held = sums if self.held is None else self.held.add(sums, fill_value=0).astype("int64")
        self.error += error
        if len(held) > self.k:
            cut = int(held.nlargest(self.k + 1).iloc[-1])
            self.error += cut
            held = held - cut
            held = held[held > 0]
        self.held = held


def _merged(rows: DataFrame, keys: list[str], k: int, size: str) -> DataFrame:
    """One sketch for each ``part``: rows of keys with ``size``; error in every row, and in one row without a key."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join(["part long", *(f"{c} {t}" for c, t in kinds.items()), "held long, error long"])

    def run(batches):
        part, sketch, arrow = None, None, None

        def out():
            frame = sketch.held if sketch.held is not None else pd.Series([], dtype="int64")
            names = list(zip(*frame.index)) if len(frame) else [[] for _ in keys]
            columns = [pa.array([None, *own], t) for own, t in zip(names, arrow)]
            n = len(frame) + 1
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), *columns, pa.array([0, *frame.tolist()], pa.int64()), pa.array([sketch.error, *[0] * len(frame)], pa.int64())], names=["part", *keys, "held", "error"])

        for batch in batches:
            arrow = [batch.schema.field(1 + i).type for i in range(len(keys))]
            whole = batch.to_pandas()
            for own, rows_ in whole.groupby("part", sort=True):
                if part is not None and own != part:
                    yield out()
                if own != part:
                    part, sketch = int(own), Sketch(k)
                real = rows_[rows_["real"]]
                sketch.add(real.groupby(keys, sort=False)["size"].sum(), int(rows_["error"].sum()))
        if part is not None:
            yield out()

    columns = rows.select("part", *keys, F.col(size).cast("long").alias("size"), "error", "real")
    return columns.mapInArrow(run, schema)


def sketch(rows: DataFrame, k: int, keys: tuple[str, ...] = KEY, size: str = "wire_len") -> DataFrame:
    """The keys that a sketch of k holds, with held (at most the true weight) and most (at least it)."""
    keys = list(keys)
    own = rows.select(*keys, F.col(size)).withColumns({"part": F.lit(0).cast("long"), "error": F.lit(0).cast("long"), "real": F.lit(True)})
    # A sketch a task, of its own rows: nothing moves yet.
    parts = cut(_merged(own, keys, k, size).withColumn("part", F.spark_partition_id().cast("long")), "sketches")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last:
        last //= FAN
        dealt = parts.withColumns({"part": F.floor(F.col("part") / FAN), "real": F.col(keys[0]).isNotNull()})
        dealt = dealt.repartition(last + 1, "part").sortWithinPartitions("part")
        parts = cut(_merged(dealt, keys, k, "held"), "sketches")
    error = parts.agg(F.sum("error")).first()[0] or 0
    return parts.filter(F.col(keys[0]).isNotNull()).select(*keys, "held", (F.col("held") + F.lit(error)).alias("most"))


def above_share(rows: DataFrame, one_in: int, keys: tuple[str, ...] = KEY, size: str = "wire_len") -> DataFrame:
    """Keys with more than one in ``one_in`` of all weight, and their exact weight: what a sketch of so many counters holds,
    summed again."""
    total = rows.agg(F.sum(size).alias("all")).first()[0] or 0
    near = sketch(rows, one_in, keys, size).select(*keys)
    sums = rows.join(F.broadcast(near), list(keys), "left_semi").groupBy(*keys).agg(F.sum(size).alias("weight"))  # at most one_in rows
    return sums.filter(F.col("weight") * one_in > F.lit(total))
