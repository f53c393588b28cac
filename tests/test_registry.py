"""Registered features: order, parameters, errors, and values against pandas."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import features as fx
from tidemark.functions.registry import Feature, Parameter, Registry
from tidemark.operators import feature_frame

EVENTS = "/root/testdata/sf0.001/events.parquet"


def chain():
    return Registry().register(
        Feature("c", "mine", "a + b * {k}", (Parameter("k", 2, 1, 5),)),
        Feature("b", "mine", "a / nullif(close, 0)", shift=1),
        Feature("a", "mine", lambda n: f"avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)", (Parameter("n", 3, 2),)),
        Feature("d", "mine", "signal_x_high_vol_stress + 'c' IS NULL"),
    )


def test_plan():
    own, wanted = chain().plan(["c"])
    assert [sorted(level) for level in own] == [["a"], ["__b"], ["b"], ["c"]] and wanted == []
    assert own[0]["a"].endswith("ROWS 2 PRECEDING)") and own[-1]["c"] == "a + b * 2"
    own, _ = chain().plan(["c"], {"k": 99, "n": 0})
    assert own[0]["a"].endswith("ROWS 1 PRECEDING)") and own[-1]["c"] == "a + b * 5"
    own, wanted = chain().plan(["d", "rsi_1h"])
    assert [*own[0]] == ["d"] and len(own) == 1  # the c in quotes is no feature
    assert wanted == ["ema_fast_slow", "high_vol_stress_indicator", "realized_vol_1h", "rsi_1h", "signal_x_high_vol_stress"] == fx.resolve(wanted)
    assert Registry().plan([]) == ([], [])


def test_errors():
    made = lambda *x: Registry().register(*x)
    for bad in (
        Feature("rsi_1h", "mine", "1"),
        Feature("close", "mine", "1"),
        Feature("no name", "mine", "1"),
        Feature("__x", "mine", "1"),
        Feature("x", "momentum", "1"),
        Feature("x", "mine", "{n}"),
        Feature("x", "mine", "1", (Parameter("n", 1), Parameter("n", 2))),
        Feature("x", "mine", "close", shift=-1),
    ):
        with pytest.raises(ValueError):
            made(bad)
    with pytest.raises(ValueError, match="taken"):
        made(Feature("x", "mine", "1"), Feature("x", "mine", "2"))
    with pytest.raises(ValueError, match="rest on each other: x, y"):
        made(Feature("x", "mine", "y"), Feature("y", "mine", "x"), Feature("z", "mine", "close")).plan("xyz")
    with pytest.raises(ValueError, match="unknown features: q"):
        chain().plan(["q"])
    with pytest.raises(ValueError, match="unknown parameters: m"):
        chain().plan(["c"], {"m": 1})


def test_lineage():
    got = {x["name"]: x for x in chain().lineage(settings={"k": 9})}
    assert [*got] == ["a", "b", "c", "d"]
    assert got["c"]["template"] == "a + b * {k}" and got["c"]["formula"] == "a + b * 5" and got["c"]["parameters"] == {"k": 5} and got["c"]["features"] == ["a", "b"]
    assert got["b"]["inputs"] == ["close"] and got["b"]["shift"] == 1 and got["a"]["template"] is None
    assert [x["name"] for x in chain().lineage(["d"])] == ["d"]


def test_values(spark):
    frames = feature_frame.frames_of(spark.read.parquet(EVENTS))
    got = feature_frame.build_with(chain(), ["a", "c", "return_1h_6"], {"n": 4}, frames, "purchase")
    assert got.columns == ["symbol", "ts", *feature_frame.PRICES, "a", "c", "return_1h_6"]
    rows = got.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    a = rows.groupby("symbol").close.rolling(4, min_periods=1).mean().reset_index(level=0, drop=True)
    b = (a / rows.close).groupby(rows.symbol).shift(1)
    np.testing.assert_allclose(rows.a, a)
    np.testing.assert_allclose(rows.c.astype(float), a + 2 * b)
    plain = feature_frame.build(*frames, "purchase", ["return_1h_6"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_series_equal(plain.return_1h_6, rows.return_1h_6)
    empty = feature_frame.build_with(chain(), ["c"], {}, [f.limit(0) for f in frames], "purchase")
    assert empty.count() == 0
    scans = got._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 1  # neither series nor the higher timeframe are read
