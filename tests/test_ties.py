"""Queries on rows at one instant, constant series and larger sums, against their SQL; NaN and null are told apart."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewright import catalog
from tidewright.frames import neighbours, quotient
from tidewright.operators import derivative

SF = "/root/testdata/sf0.001"


def plain(rows):
    value = lambda v: v if not isinstance(v, float) else "nan" if v != v else round(v, 4) + 0.0
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Every third event twice, under another key; the values of clicks are all one."""
    top = tmp_path_factory.mktemp("tied")
    rows = f"SELECT event_id, ts, user_id, event_type, CASE event_type WHEN 'click' THEN 7.5 ELSE value END AS value, props FROM '{SF}/events.parquet'"
    duckdb.connect().execute(f"COPY ({rows} UNION ALL SELECT event_id + 1000000, ts, user_id, event_type, value, props FROM ({rows}) WHERE event_id % 3 = 0) TO '{top}/events.parquet' (FORMAT parquet)")
    return str(top)


def against_sql(spark, top, name, table):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{top}/{table}.parquet'")
    want = duck.sql(catalog.ORACLES[name])
    got = entry.queries()[name](spark, top).select(*want.columns)
    a, b = plain(got.collect()), plain(want.fetchall())
    assert a == b and a
    return a


def test_quotients(spark):
    pairs = [(3.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (math.nan, 0.0), (1.0, math.nan), (None, 0.0), (1.0, None)]
    got = spark.createDataFrame(pairs, "a double, b double").select(quotient(F.col("a"), F.col("b"))).collect()
    assert [None if v is None else str(v) for (v,) in got] == ["1.5", "inf", "-inf", "nan", "-inf", "nan", "nan", None, None]


def test_differences_at_one_instant(spark, tied):
    rows = against_sql(spark, tied, "finite_difference", "events")
    assert 0 < sum("nan" in r for r in rows) < len(rows)


def test_strict_differences_refuse_them(spark):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("a", 1.0, 3.0)], "series_id string, t double, x double")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        derivative.finite_difference(rows, ["x"]).collect()


def test_bins_with_steps_of_no_time(spark, tied):
    rows = against_sql(spark, tied, "kramers_moyal_bins", "events")
    assert any("nan" in r for r in rows) and any("nan" not in r for r in rows)
    assert [r[1] for r in rows if r[0] == "click"] == [11]


def test_rows_at_one_instant_keep_the_order_of_their_keys(spark, tmp_path):
    """In a file by event_id as in one against it, in one window as in chunks."""
    events = [(k, t, "a", x) for k, t, x in [(1, 0, 1.0), (2, 1, 4.0), (3, 1, 8.0), (4, 2, 2.0), (5, 2, 6.0), (6, 2, 7.0), (7, 4, 3.0)]]
    rows = ", ".join(f"({k}::BIGINT, TIMESTAMP '2024-01-01' + to_seconds({t}), 5::BIGINT, '{e}', {x}::DOUBLE, '')" for k, t, e, x in reversed(events))
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r)[1:] for r in entry.queries()["finite_difference"](spark, str(tmp_path)).collect())
    # before the first tie: to 4.0, not 8.0; after the last: from 7.0, not 2.0 or 6.0
    assert got[0] == (0.0, 3.0) and got[-1] == (4.0, -2.0)
    frame = spark.createDataFrame([(e, float(t), x, k) for k, t, e, x in reversed(events)], "series_id string, t double, x double, k long")
    for size in (None, 3):
        near = {r["k"]: (r["prev_x"], r["next_x"]) for r in neighbours(frame, ["x"], size, ("k",)).collect()}
        assert near == {1: (None, 4.0), 2: (1.0, 8.0), 3: (4.0, 2.0), 4: (8.0, 6.0), 5: (2.0, 7.0), 6: (6.0, 3.0), 7: (7.0, None)}


def test_laws_of_larger_sums_have_the_threshold_of_their_sql(spark, tmp_path):
    """Six times the orders: a coefficient is below the threshold that is above it for a scaled term."""
    duckdb.connect().execute(f"COPY (SELECT o.* REPLACE (o_orderkey + 1000000 * k AS o_orderkey) FROM '/root/testdata/sf0.01/orders.parquet' o, range(6) r(k)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert len(against_sql(spark, str(tmp_path), "discover_laws", "orders")) == 11
