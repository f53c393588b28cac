"""Queries on bars against their SQL where events share a time, so that a bar has several first and last ones."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The events to ten minutes, in order of id."""
    folder = tmp_path_factory.mktemp("ties")
    duckdb.sql(f"COPY (SELECT * REPLACE (time_bucket(INTERVAL 10 MINUTES, ts) AS ts) FROM '/root/testdata/sf0.01/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize(
    "name, keys",
    [
        ("candles_1h", ["symbol", "open_time"]),
        ("candles_4h", ["symbol", "open_time"]),
        ("tumbling_bars", ["symbol", "open_time"]),
        ("payload_klines", ["symbol", "open_time"]),
        ("asof_events_candles", ["event_id"]),
        ("features_all", ["symbol", "ts"]),
        ("registered_features", ["symbol", "ts"]),
        ("final_training_rows", ["symbol", "ts"]),
    ],
)
def test_bars_of_tied_events_equal_their_sql(spark, tied, name, keys):
    run, sql = catalogue.QUERIES[name]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tied}/events.parquet'")
        want = db.sql(sql).df().sort_values(keys).reset_index(drop=True)
    got = run(spark, tied).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(got) > 300
    got, want = got.fillna(float("nan")), want.fillna(float("nan"))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)  # rounded to six decimals


def test_events_without_a_value_are_no_ends(spark, tmp_path):
    rows = "(1, 5, NULL), (2, 5, 1.0), (3, 6, 9.0), (4, 7, 3.0), (5, 7, 2.0), (6, 8, NULL)"
    duckdb.sql(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, make_timestamp(CAST(t AS BIGINT)) AS ts, 'A' AS event_type, CAST(v AS DOUBLE) AS value FROM (VALUES {rows}) x(i, t, v)) TO '{tmp_path}/events.parquet'")
    for name in ("candles_1h", "tumbling_bars"):
        got = catalogue.QUERIES[name][0](spark, str(tmp_path)).first()
        assert (got["open"], got["high"], got["low"], got["close"], got["volume"]) == (1.0, 9.0, 1.0, 3.0, 6), name
