"""Folds over flows: state that needs a flow's rows in frame order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def fold(rows: DataFrame, key: list[str], names: list[str], result: dict[str, str], start: Callable, step: Callable, end: Callable, many: bool = False) -> DataFrame:
    """Rows of key and ``result``. ``start()`` makes a state, ``step(state, *values of
    names)`` takes a row and may give rows, ``end(state)`` gives the result, or None for no row; with
    ``many`` a list of rows. names[0] gives the order, then names[1].

    Rows are dealt by key and sorted, and the fold streams through them with one state at a time, so no
    flow is ever collected; a very long flow is one sequential task by definition."""
    rows = rows.select(*key, *(F.col(c).alias(f"__{i}") for i, c in enumerate(names)))
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key), *(f"{c} {t}" for c, t in result.items())])

    def run(batches):
        current, state, kinds = None, None, None

        def out(done):
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, *(_ARROW[t] for t in result.values())])], names=[*key, *result])

        def close(done):
            if current is not None and (found := end(state)) is not None:
                done.extend((*current, *row) for row in (found if many else [found]))

        for batch in batches:
            kinds, done = [batch.schema.field(i).type for i in range(len(key))], []
            columns = [c.to_pylist() for c in batch.columns]
            for own, values in zip(zip(*columns[: len(key)]), zip(*columns[len(key) :])):
                if own != current:
                    close(done)
                    current, state = own, start()
                done.extend((*own, *row) for row in step(state, *values) or ())
            if done:
                yield out(done)
        done = []
        close(done)
        if done:
            yield out(done)

    return rows.repartition(*key).sortWithinPartitions(*key, *("__0", "__1")[: len(names)]).mapInArrow(run, schema)
