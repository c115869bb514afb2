"""Sketches of heavy hitters keep their bounds, whatever is merged in which order."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.operators import heavy_hitters
from tracelake.operators.heavy_hitters import Sketch


def weighted(seed, n):
    r = random.Random(seed)
    return [(int(r.paretovariate(0.7)) % 5000, r.choice((0, 1, 60, 1500))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_in_any_order(seed):
    r, rows, k = random.Random(seed), weighted(seed, 4000), 20
    true, total = Counter(), sum(w for _, w in rows)
    for key, w in rows:
        true[key] += w
    parts, at = [], 0
    while at < len(rows):
        own, sketch = rows[at : at + r.randrange(1, 700)], Sketch(k)
        at += len(own)
        while own:
            some, own = own[:37], own[37:]
            sketch.add(pd.DataFrame(some, columns=["k", "w"]).groupby("k")["w"].sum())
        parts.append(sketch)
    for _ in range(3):
        r.shuffle(parts)
        whole = Sketch(k)
        for p in parts:
            whole.add(p.held, p.error)
        assert len(whole.held) <= k and whole.error <= total / (k + 1)
        for key, w in true.items():
            held = int(whole.held.get(key, 0))
            assert held <= w <= held + whole.error
        assert {key for key, w in true.items() if w > total / (k + 1)} <= set(whole.held.index)


def test_sketch_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(heavy_hitters, "FAN", 2)
    rows = [(k, str(k % 3), w) for k, w in weighted(9, 5000)]
    df = spark.createDataFrame(rows, "k long, s string, wire_len long").repartition(7)
    true = Counter()
    for k, s, w in rows:
        true[k, s] += w
    total = sum(true.values())
    got = heavy_hitters.sketch(df, 30, ("k", "s")).collect()
    assert 0 < len(got) <= 30 and all(r.held <= true[r.k, r.s] <= r.most <= r.held + total / 31 for r in got)
    above = {(r.k, r.s): r.weight for r in heavy_hitters.above_share(df, 50, ("k", "s")).collect()}
    assert above == {key: w for key, w in true.items() if w * 50 > total} and above
    assert heavy_hitters.above_share(df.limit(0), 50, ("k", "s")).count() == 0
    few = heavy_hitters.sketch(df.filter(F.col("k") < 5), heavy_hitters.counters(5), ("k", "s")).collect()
    assert {(r.k, r.s): (r.held, r.most) for r in few} == {key: (w, w) for key, w in true.items() if key[0] < 5 and w}
