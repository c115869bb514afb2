"""Each query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from tracelake.functions.bpf import compile_filter
from tracelake.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    ours = catalog.QUERIES[name](spark, DATA)
    columns = sorted(ours.columns)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    rows = want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in ours.select(*columns).collect())


@pytest.mark.parametrize("text", ["tcp port", "host", "foo", "(tcp", "port 1-2", "portrange 5", "tcp udp"])
def test_filters_that_are_rejected(spark, text):
    with pytest.raises(ValueError):
        compile_filter(text)


def test_alerts_come_from_candidates(spark):
    from tracelake.operators import detectors, flows

    packets = flows.with_watermark(catalog.trace(spark, DATA)).cache()
    hour = catalog.HOUR
    keys = {tuple(r) for r in detectors.syn_candidates(packets, 24 * hour, 2, 1).select("dst_ip", "dst_port").collect()}
    alerts = detectors.syn_flood_alerts(packets, 24 * hour, 2, 1, 0).collect()
    assert alerts and {(r.dst_ip, r.dst_port) for r in alerts} <= keys
    # Without a cooldown every candidate row in time order is an alert.
    assert len(alerts) == detectors.syn_candidates(packets, 24 * hour, 2, 1).count()
