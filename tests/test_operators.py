"""As-of join, labels, folds, metrics, simulator, reports, stored tables, payloads, journal."""

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels, metrics, reports, simulator, validation
from tidemark.operators.asof import asof
from tidemark.sources import exchange, journal, tables

HOUR = 3_600_000


@pytest.mark.parametrize("bucket", [None, 10])
def test_asof(spark, bucket):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 3, 200).astype(str), "t": rng.integers(0, 100, 200)}).assign(n=range(200))
    right = pd.DataFrame({"k": rng.integers(0, 2, 40).astype(str), "t": rng.permutation(100)[:40], "v": rng.normal(size=40)}).sort_values("t")
    right.loc[right.index[::7], "v"] = np.nan
    want = pd.merge_asof(left.sort_values("t"), right, on="t", by="k").sort_values("n")
    rights = spark.createDataFrame(right).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = asof(spark.createDataFrame(left), rights, "k", "t", ["v"], bucket).toPandas().sort_values("n")
    np.testing.assert_allclose(got.v.astype(float), want.v)  # a NULL of the latest row counts
    assert asof(spark.createDataFrame(left), rights.limit(0), "k", "t", ["v"], bucket).where("v is not null").count() == 0


def bars(path, rvol=0.01):
    """One symbol; path: (open, high, low, close) of each bar."""
    return [("S", i * HOUR, *map(float, p), 1.0, rvol) for i, p in enumerate(path)]


BAR = "symbol string, ts long, open double, high double, low double, close double, volume double, realized_vol_1h double"
FIXED = labels.Barriers(base=3, adaptive=False, dynamic=False, fixed_stop=0.02, fixed_take=0.03)


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ([(100, 100, 100, 100), (100, 101, 99.5, 100), (100, 104, 100, 103), *[(103, 103, 103, 103)] * 4], 1),  # take only
        ([(100, 100, 100, 100), (100, 100.5, 99, 99), (99, 99, 96, 96), *[(96, 96, 96, 96)] * 4], -1),
        ([(100, 100, 100, 100), (100, 105, 95, 100), *[(100, 100, 100, 100)] * 5], 0),  # both on one bar: the stop counts
        ([*[(100, 100.1, 99.9, 100)] * 7], 0),  # no touch
        ([(100, 100, 100, 100), (100, 104, 99, 103), *[(103, 103, 103, 103)] * 5], 1),  # the entry bar itself
    ],
)
def test_label_paths(spark, path, want):
    got = labels.label(spark.createDataFrame(bars(path), BAR), FIXED).orderBy("ts").collect()
    assert got[0]["Target"] == want and [r["Target"] for r in got[-3:]] == [0, 0, 0]


def test_label_gap_and_nulls(spark):
    gap = labels.label(spark.createDataFrame(bars([(100, 100, 100, 100), (100, 100, 100, 100), (90, 91, 89, 90), *[(90, 90, 90, 90)] * 4]), BAR), FIXED).orderBy("ts").first()
    entry = 100 * 1.0003
    assert gap["long_pnl"] == pytest.approx((90 * 0.9997 - entry) / entry - 0.0008)  # fills at the open beyond the stop
    few = labels.label(spark.createDataFrame(bars([(1, 1, 1, 1)] * 2), BAR))
    assert [r["Target"] for r in few.collect()] == [0, 0]
    none = spark.createDataFrame(bars([(100, 101, 99, 100)] * 30, None), BAR)
    out = labels.label(none).orderBy("ts").collect()
    assert {r["horizon"] for r in out} == {12} and out[0]["barrier_stop_pct"] is None and out[0]["long_pnl"] == 0
    assert labels.finalise(labels.label(none), ["open", "barrier_stop_pct"]).count() == 0
    with pytest.raises(ValueError):
        labels.finalise(none, ["missing"])
    assert labels.null_profile(none, ["open", "realized_vol_1h"]).collect()[0]["missing"] == 30


def test_folds(spark):
    frame = spark.createDataFrame([(s, i * HOUR) for s in "ab" for i in range(60)], "symbol string, ts long")
    got = validation.expanding_folds(frame, 5, 4).toPandas()
    for k in range(1, 6):
        test, train = got[(got.fold == k) & (got.role == "test")].ts // HOUR, got[(got.fold == k) & (got.role == "train")].ts // HOUR
        assert sorted(test) == list(range(k * 10, k * 10 + 10)) and sorted(train) == list(range(k * 10 - 4))
    start = int(datetime(2024, 1, 31).timestamp() * 1000)
    year = spark.createDataFrame([(start + i * 86_400_000,) for i in range(150)], "ts long")
    months = validation.month_folds(year, 2, 1, expanding=False, gap=3).toPandas()
    assert months.fold.nunique() == 3
    assert validation.add_months(datetime(2024, 1, 31), 1) == datetime(2024, 2, 29) and validation.add_months(datetime(2024, 12, 5), 1) == datetime(2025, 1, 5)
    for _, f in months.groupby("fold"):
        assert f[f.role == "train"].ts.max() < f[f.role == "test"].ts.min() - 3 * 86_400_000
    assert validation.month_folds(year.limit(0), 2).count() == 0


def test_clip_and_eval_split(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    frame = spark.createDataFrame([("s", i, float(v), int(v > 0)) for i, v in enumerate(x)] + [("s", 900, None, 0)], "symbol string, ts long, x double, y int")
    bounds = validation.clip_bounds(frame, ["x"])
    assert bounds["x"] == pytest.approx(tuple(np.quantile(x, [0.01, 0.99])))
    got = validation.clipped(frame, bounds).toPandas()
    assert got.x.isna().sum() == 1 and got.x.max() == pytest.approx(bounds["x"][1])
    plan = validation.eval_split(frame)
    labels_in_order = [int(v > 0) for v in x] + [0]
    gap = lambda n: abs(np.mean(labels_in_order[-n:]) - np.mean(labels_in_order[:-n]))
    first = next(n for n in (75, 100, 125, 150, 175, 200) if gap(n) <= 0.08)
    assert plan["eval_size"] == first and plan["expanded"] == (first != 75) and plan["rate_gap"] == pytest.approx(gap(first))
    assert validation.eval_split(frame.limit(1))["eval_size"] == 1


def test_metrics(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(size=400), 2)
    y = (rng.uniform(size=400) < p).astype(int)
    rows = spark.createDataFrame([(int(a), float(b), float(1 - b)) for a, b in zip(y, p)], "y int, p_long double, p_short double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hit = (p >= t) & (y == 1)
        ap += (hit.sum() - seen) / (y == 1).sum() * hit.sum() / (p >= t).sum()
        seen = hit.sum()
    got = metrics.ranking(rows).first()
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    assert metrics.ranking(rows.where("y = 1")).first()["roc_auc"] is None
    c = metrics.classification(rows).first()
    assert c["mcc"] == pytest.approx(np.corrcoef(p >= 0.5, y)[0, 1])
    both = metrics.thresholds(spark.createDataFrame([(1, 0.5, 0.5)], "y int, p_long double, p_short double"), (0.5,)).first()
    assert (both["short_signals"], both["long_signals"], both["long_precision"]) == (1, 0, None)
    imp = metrics.importances(spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0), (2, "a", 4.0)], "fold int, feature string, gain double")).toPandas().set_index("feature")
    assert imp.loc["a", "std_gain"] == pytest.approx(math.sqrt(2)) and imp.loc["b", "std_gain"] == 0 and imp.loc["b", "nonzero"] == 0


def play(spark, path, signals, symbols=("S",), **rules):
    """path: bars by symbol; signals: (symbol, bar, p_long)."""
    candles = [("r", s, i * HOUR, *map(float, p)) for s in symbols for i, p in enumerate(path[s] if isinstance(path, dict) else path) if p]
    sig = [("r", s, (i + 1) * HOUR, p, 1 - p, 0.02, 0.04) for s, i, p in signals]
    rows = simulator.steps(spark.createDataFrame(candles, "run_id string, symbol string, open_time long, open double, high double, low double, close double"), spark.createDataFrame(sig, "run_id string, symbol string, ts long, p_long double, p_short double, barrier_stop_pct double, barrier_take_pct double"), HOUR)
    out = simulator.simulate(rows, simulator.Rules(**{"balance": 1000.0, "risk": 0.01, **rules}))
    return out.where("kind = 'trade'").orderBy("i", "trade_number").collect(), out


FLAT = (100, 100.5, 99.5, 100)


def test_simulator_take_and_final(spark):
    trades, out = play(spark, [FLAT, FLAT, (100, 105, 100, 104), FLAT, FLAT], [("S", 0, 0.8), ("S", 2, 0.2)])
    assert [(t["reason"], t["direction"]) for t in trades] == [("TP", "LONG"), ("FINAL", "SHORT")]
    entry = 100 * 1.0003
    assert trades[0]["pnl_pct"] == pytest.approx(1.04 * 0.9997 - 1 - 0.0008) and trades[0]["pnl_abs"] == pytest.approx(500 * trades[0]["pnl_pct"])
    assert trades[1]["pnl_pct"] == pytest.approx((100 * 0.9997 - 100 * 1.0003) / (100 * 0.9997) - 0.0008)
    end = out.where("kind = 'equity'").agg(F.max_by("equity", "i")).first()[0]
    assert end == pytest.approx(1000 + sum(t["pnl_abs"] for t in trades)) and entry > 100


def test_simulator_rules(spark):
    crash = (100, 100, 97, 97.5)
    back = (100, 100, 97, 100)
    trades, _ = play(spark, [FLAT, crash, *[back] * 12], [("S", i, 0.9) for i in range(14)], cooldown=3, stops_per_day=0)
    assert [t["i"] for t in trades][:3] == [0, 3, 6]  # stopped on the entry bar, then waits
    trades, _ = play(spark, [FLAT, *[back] * 10], [("S", i, 0.9) for i in range(11)], cooldown=0, stops_per_day=2)
    assert len(trades) == 2  # the day's stops are used up
    trades, _ = play(spark, [FLAT, *[back] * 6], [("S", i, 0.9) for i in range(7)], cooldown=0, stops_per_day=0, reduce_after=2)
    sizes = [t["commission"] / 0.0008 for t in trades]
    assert sizes[2] < 0.6 * sizes[1]  # half the risk after two losses
    trades, _ = play(spark, {"A": [FLAT] * 4, "B": [FLAT] * 4, "C": [FLAT] * 4}, [("A", 0, 0.7), ("B", 0, 0.9), ("C", 0, 0.9)], ("A", "B", "C"), new_per_bar=1, most_open=2)
    assert [t["symbol"] for t in trades] == ["B"]  # best score, of equals the first
    trades, _ = play(spark, [FLAT] * 4, [("S", 0, 0.9)], balance=15.0)
    assert not trades  # notional below ten
    trades, _ = play(spark, {"A": [FLAT, None, FLAT, FLAT], "B": [FLAT] * 4}, [("A", 0, 0.9)], ("A", "B"))
    assert not trades  # no next bar
    trades, _ = play(spark, [FLAT] * 4, [("S", 0, 0.55), ("S", 1, 0.5), ("S", 2, 0.53)])
    assert [t["i"] for t in trades] == [3] and trades[0]["reason"] == "FINAL"


def test_reports(spark):
    rows = [("r", "trade", 0, 0, "A", "LONG", "TP", 0.1, 10.0, 1.0, None), ("r", "trade", 1, 40 * 86_400_000, "B", "LONG", "SL", -0.1, -5.0, 1.0, None)] + [("r", "equity", i, i * 20 * 86_400_000, None, None, None, None, None, None, e) for i, e in enumerate([100.0, 110.0, 99.0])]
    x = spark.createDataFrame(rows, "run_id string, kind string, i long, ts long, symbol string, direction string, reason string, pnl_pct double, pnl_abs double, commission double, equity double")
    assert [(r["month"], r["trades"], r["losses"]) for r in reports.by_month(x).orderBy("month").collect()] == [("1970-01", 1, 0), ("1970-02", 1, 1)]
    assert {r["direction"]: r["trades"] for r in reports.by_direction(x).collect()} == {"LONG": 2, "SHORT": 0}
    t = reports.totals(x, 100.0).first()
    assert (t["profit_factor"], t["fees"], t["return_pct"]) == (2.0, 2.0, 5.0)
    assert reports.drawdown(x, 100.0).first()["max_drawdown"] == pytest.approx(10.0)
    days = reports.daily_equity(x).orderBy("day").collect()
    assert len(days) == 41 and days[5]["equity"] == 100 and days[20]["change"] == pytest.approx(0.1)
    assert reports.risk(x).first()["cagr"] == pytest.approx((99 / 100) ** (365 / 40) - 1)
    assert {r["symbol"]: r["sl"] for r in reports.by_symbol(x).collect()} == {"A": 0, "B": 1}


def test_months_begin_with_the_second_bar(spark):
    """Nothing is traded on a run's first bar, so a month that holds only that bar is no month of the report."""
    rows = [("r", "equity", i, t * 86_400_000, e) for i, (t, e) in enumerate([(30, 100.0), (31, 120.0), (32, 90.0), (33, 99.0)])]
    x = spark.createDataFrame(rows, "run_id string, kind string, i long, ts long, equity double")
    x = x.selectExpr("*", "cast(null as string) symbol", "cast(null as double) pnl_abs", "cast(null as double) pnl_pct")
    assert [r["month"] for r in reports.by_month(x).collect()] == ["1970-02"]
    found = reports.risk(x, 100.0).first()
    assert found["calmar"] == pytest.approx(((99 / 100) ** (365 / 3) - 1) / 0.25)
    assert reports.risk(x).columns == ["run_id", "sharpe", "sortino", "cagr"]


def test_overlapping_levels_and_best(spark):
    c = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 9), (None, 2)], "symbol string, open_time long")
    assert {r["symbol"] for r in simulator.overlapping(c, 1, 5).collect()} == {"A"}
    assert {r["symbol"] for r in simulator.overlapping(c, 1, 5, 1).collect()} == {"A", "B"}
    assert metrics.levels() == (0.5, 0.55, 0.6, 0.65, 0.7) and metrics.levels(0.584)[1] == 0.58
    gains = spark.createDataFrame([(f, n, g) for f in (1, 2) for n, g in (("x", 3.0), ("y", 5.0), ("z", 3.0), ("w", 0.0))], "fold int, feature string, gain double")
    best = metrics.best_features(metrics.importances(gains), 3).orderBy("place").collect()
    assert [(r["place"], r["feature"], r["nonzero"]) for r in best] == [(1, "y", 2), (2, "x", 2), (3, "z", 2)]
    y = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2), (2, 1, 0.1), (2, 0, 0.2)], "fold int, y int, p_long double")
    assert {r["fold"]: r["accuracy"] for r in metrics.classification(y, ["fold"]).collect()} == {1: 1.0, 2: 0.5}
    folds = spark.createDataFrame([(1, 0.5), (2, 0.7)], "fold int, accuracy double")
    assert metrics.stability(folds).first()["accuracy_range"] == pytest.approx(0.2)


def test_store_and_sync(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    make = lambda *t: spark.createDataFrame([("X", "1h", i * HOUR, 1.0, 2.0, 0.5, float(v), 1.0, 1.0) for i, v in t], tables.SCHEMAS["candles"])
    assert store.read("candles").count() == 0 and not store.exists("candles")
    assert store.insert_new("candles", make((0, 1), (1, 1))) == 2
    assert store.insert_new("candles", make((1, 9), (2, 2))) == 1  # the row that is there wins
    assert [r["close"] for r in store.scan("candles", ["X"], "1h", HOUR, 2 * HOUR).orderBy("open_time").collect()] == [1.0, 2.0]
    asked = []

    def fetch(a, b):
        asked.append((a // HOUR, b // HOUR))
        return make(*[(i, 3) for i in range(a // HOUR, b // HOUR + 1) if i <= 4])

    args = (store, "candles", "X", "1h", HOUR, 0)
    assert tables.sync(*args, 4 * HOUR, fetch) == 2 and asked == [(3, 4)]
    assert tables.sync(*args, 6 * HOUR, fetch) == 0 and asked[-1] == (5, 6)
    assert store.read("data_sync_state").first()["last_checked_ts"] == 6 * HOUR
    n = len(asked)
    assert tables.sync(*args, 6 * HOUR, fetch) == 0 and len(asked) == n  # known to be empty
    assert store.bounds("candles").first()["n"] == 5
    frame = spark.createDataFrame([("X", 1, 0.5), ("Y", 1, 0.7)], "symbol string, ts long, f double")
    store.replace_features(frame)
    store.replace_features(frame.where("symbol = 'X'").withColumn("f", F.lit(0.9)))
    assert {r["symbol"]: r["f"] for r in store.load_features(["X", "Y"]).collect()} == {"X": 0.9, "Y": 0.7}
    with pytest.warns(UserWarning, match="no features of Z"):
        assert store.load_features(["Z"]).count() == 0
    with pytest.warns(UserWarning, match="no feature table"):
        assert tables.Store(spark, str(tmp_path / "none")).load_features(["X"]).columns == ["symbol", "ts"]
    assert tables.keep_last(frame.unionByName(frame.withColumn("ts", F.lit(5).cast("long"))), ["symbol"], "ts").select("ts").distinct().first()[0] == 5


def test_series_windows(spark):
    wanted = spark.createDataFrame([("A", "1h", 10, 0, 95, 20), ("B", "1h", 10, 0, 95, None), ("C", "1h", 10, 0, 95, 0), ("D", "1h", 10, 0, 95, 200), ("E", "1h", 10, None, 95, None), ("F", "4h", 40, 0, None, 0)], "symbol string, timeframe string, step_ms long, start long, end long, listed long")
    marks = spark.createDataFrame([("B", "1h", 50), ("C", "1h", 90), ("A", "4h", 90)], "symbol string, timeframe string, last long")
    state = spark.createDataFrame([("B", "1h", 70)], "symbol string, timeframe string, last_checked_ts long")
    got = lambda m, s, most=3: sorted((r["symbol"], r["k"], r["start"], r["end"]) for r in tables.series_windows(wanted, m, s, most).collect())
    # A begins where it was listed, B behind what was checked, C is up to date, D was listed later, E and F lack an end or a start
    assert got(marks, state) == [("A", 0, 20, 40), ("A", 1, 50, 70), ("A", 2, 80, 95), ("B", 0, 80, 95)]
    assert [x for x in got(marks, state.limit(0), 1) if x[0] == "B"] == [("B", k, 60 + 10 * k, 60 + 10 * k) for k in range(4)]
    assert len(got(marks.drop("timeframe").where("symbol = 'C'"), state.limit(0), 100)) == 2  # A and B from their starts
    assert got(marks.limit(0), state.limit(0), 100)[0] == ("A", 0, 20, 95)
    assert tables.series_windows(wanted.limit(0), marks, state).count() == 0


def test_sync_all(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    kind = tables.SCHEMAS["candles"]
    bar = lambda s, i: (s, "1h", i * HOUR, 1.0, 2.0, 0.5, 1.0, 1.0, 1.0)
    store.insert_new("candles", spark.createDataFrame([bar("A", 0), bar("A", 1), bar("C", 0)], kind))
    asked, has, down = [], {"A": 3, "B": 5, "C": 0, "D": 9}, {"D"}

    def fetch(windows):
        asked.append(sorted((r["symbol"], r["start"] // HOUR, r["end"] // HOUR) for r in windows.collect()))
        rows = [bar(s, i) for s, a, b in asked[-1] for i in range(a, b + 1) if i <= has[s]]
        return spark.createDataFrame([*rows, *rows[:1], *[(s, "1h", *[None] * 7) for s in down]], kind)

    def run(end):
        wanted = spark.createDataFrame([(s, "1h", HOUR, 0, end * HOUR) for s in "ABCD"], "symbol string, timeframe string, step_ms long, start long, end long")
        return {r["symbol"]: (r["added"], r["failed"]) for r in tables.sync_all(store, "candles", wanted, fetch, 4).collect()}

    assert run(5) == {"A": (2, False), "B": (6, False), "C": (0, False), "D": (0, True)}
    assert asked[0] == [("A", 2, 5), ("B", 0, 3), ("B", 4, 5), ("C", 1, 4), ("C", 5, 5), ("D", 0, 3), ("D", 4, 5)]
    state = store.read("data_sync_state").collect()
    assert [(r["symbol"], r["empty_since_ts"], r["last_checked_ts"]) for r in state] == [("C", HOUR, 5 * HOUR)]
    down.clear()
    has["C"] = 7
    assert run(5) == {"A": (0, False), "D": (6, False)}  # B is full, C known to be empty up to there
    assert run(7) == {"A": (0, False), "B": (0, False), "C": (2, False), "D": (2, False)}
    assert {r["symbol"] for r in store.read("data_sync_state").collect()} == {"A", "B"}  # C is forgotten again
    assert asked[2] == [("A", 6, 7), ("B", 6, 7), ("C", 6, 7), ("D", 6, 7)]
    assert store.bounds("candles").where("symbol = 'D'").first()["n"] == 8
    rates = tables.Store(spark, str(tmp_path / "rates"))
    answer = lambda w: w.select("symbol", F.col("start").alias("funding_time"), F.lit(0.1).alias("funding_rate"))
    wanted = spark.createDataFrame([("A", "", HOUR, 0, HOUR)], "symbol string, timeframe string, step_ms long, start long, end long")
    assert tables.sync_all(rates, "funding_rates", wanted, answer).first()["added"] == 1
    assert tables.sync_all(rates, "funding_rates", wanted.limit(0), answer).count() == 0


def test_payloads(spark, tmp_path):
    assert [tuple(r) for r in exchange.request_windows(spark, 0, 50, 10, 4, listed=20).collect()] == [(0, 20, 50)]
    assert exchange.request_windows(spark, 0, 50, 10, 4, listed=60).count() == 0
    a = json.dumps({"result": {"list": [["2", "1", "2", "0.5", "1.5", "10", "66", "7"], ["1", "1", "2", "0.5", "1.5", "10", "66", "7"]]}})
    b = json.dumps([["1", "1", "2", "0.5", "1.5", "10", "66", "7"], ["5", "1"]])
    x = spark.createDataFrame([("A", a, b)], "symbol string, payload string, other string")
    assert {r["quote_volume"] for r in exchange.klines(x, "a").collect()} == {66.0}
    other = x.select("symbol", F.col("other").alias("payload"))
    assert exchange.klines(other, "b").where("open_time = 1").first()["quote_volume"] == 7.0
    assert exchange.klines(other, "b", price_only=True).count() == 1
    f = spark.createDataFrame([("A", json.dumps({"result": {"list": [{"fundingRateTimestamp": "8", "fundingRate": "0.1"}, {"fundingRate": "0.2"}]}}))], "symbol string, payload string")
    assert [(r["funding_time"], r["funding_rate"]) for r in exchange.points(f, "a", "funding").collect()] == [(8, 0.1)]
    with pytest.raises(NotImplementedError):
        exchange.points(f, "b", "open_interest")
    assert [tuple(r) for r in exchange.request_windows(spark, 0, 25, 1, 10).orderBy("k").collect()] == [(0, 0, 9), (1, 10, 19), (2, 20, 25)]
    assert exchange.request_windows(spark, 5, 1, 1).count() == 0
    answers = tmp_path / "a.jsonl"
    answers.write_text(json.dumps({"symbol": "A", "list": [[i, 1, 1, 1, 1, 1, 1] for i in range(30)]}))
    spark.dataSource.register(exchange.BarSource)
    got = spark.read.format("exchange_bars").options(answers=str(answers), symbol="A", start="3", end="25", step_ms="1", most="10").load()
    assert sorted(r["open_time"] for r in got.collect()) == list(range(3, 26)) and got.rdd.getNumPartitions() == 3
    last = exchange.last_of_each(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, n int"), ["k"], "n")
    assert last.first()["v"] == "b"


def test_retry_and_limit():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"ok": 1}

    assert exchange.with_retry(call, wait=waits.append) == {"ok": 1} and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        exchange.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=waits.append)
    now = [0.0]
    limit = exchange.RateLimit(10, clock=lambda: now[0])
    assert limit.wait_for(6) == 0 and limit.wait_for(6) == 60
    limit.told(429, {"Retry-After": "100"})
    assert limit.wait_for(1) == 100


def test_journal(spark):
    names = [x.split(" ")[0] for x in tables.SCHEMAS["execution_trades"].split(", ")]
    row = lambda **x: tuple(x.get(n) for n in names)
    day = 86_400_000
    log = spark.createDataFrame([row(id=1, status="open", entry_notional=50.0, updated_at_ms=1), row(id=1, status="closed", exit_reason="SL", exit_ts_ms=day + 5, pnl_quote=-2.0, updated_at_ms=2), row(id=2, status="open", entry_notional=30.0, updated_at_ms=1)], tables.SCHEMAS["execution_trades"])
    s = journal.summary(journal.latest(log), day + 10, 2.0).first()
    assert tuple(s) == (1, 1, day + 5, -2.0, 15.0)
    assert journal.summary(log.limit(0), day, 0.0).first()["open_margin"] == 0.0


def test_journal_operations(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    book = journal.journal(store, " Parquet ")
    with pytest.raises(ValueError):
        journal.journal(store, "other")
    assert book.trades().count() == 0 and book.state("k") is None
    rows = spark.createDataFrame([(1, "A", 10.0), (2, "B", 20.0), (3, "A", 30.0)], "id bigint, symbol string, entry_price double")
    book.open(rows, 100)
    with pytest.raises(ValueError):
        book.open(rows.where("id = 2"), 101)
    with pytest.raises(ValueError):
        book.append(rows.withColumn("odd", F.lit(1)))
    assert book.change(spark.createDataFrame([(1, 7.5), (9, 1.0)], "id bigint, stop_pct double"), 100) == 1
    exits = spark.createDataFrame([(1, 150, 11.0, "TP", 0.1), (9, 150, 1.0, "SL", 0.0)], "id bigint, exit_ts_ms bigint, exit_price double, exit_reason string, pnl_pct double")
    assert book.close(exits, 160) == 1 and book.close(exits, 170) == 0
    got = {r["id"]: r for r in book.trades().collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["closed", "open", "open"]
    assert (got[1]["entry_price"], got[1]["stop_pct"], got[1]["exit_price"], got[1]["created_at_ms"], got[1]["updated_at_ms"]) == (10.0, 7.5, 11.0, 100, 160)
    assert sorted(r["id"] for r in book.trades("open", "A").collect()) == [3]
    book.set_state("k", "1")
    book.set_state("k", "2")
    assert book.state("k") == "2"
    assert store.tables() == ["execution_engine_state", "execution_trades"]


def test_candles_until(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    rows = [("B", "1h", 0, 1.0, 2.0, 0.5, 1.5, 3.0, None), ("A", "1h", 10, 1.0, 2.0, 0.5, 1.5, 3.0, 1.0), ("A", "1h", 0, 1.0, 2.0, 0.5, None, 3.0, 1.0), ("A", "1h", 20, 1.0, 2.0, 0.5, 1.5, 3.0, 1.0), ("A", "4h", 10, 1.0, 2.0, 0.5, 1.5, 3.0, 1.0)]
    store.insert_new("candles", spark.createDataFrame(rows, tables.SCHEMAS["candles"]))
    got = [(r["symbol"], r["open_time"], r["close_time"]) for r in store.candles_until(["A", "B"], "1h", 10, until=10).collect()]
    assert got == [("A", 10, 20), ("B", 0, 10)]
    text = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string")
    assert [r["v"] for r in tables.numbers(text, ["v"]).collect()] == [1.5, None, None]


def test_numbered_and_ranking_in_stretches(spark):
    rng = np.random.default_rng(3)
    at, score, y = rng.integers(0, 40, 500), np.round(rng.beta(2, 5, 500), 2), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(int(t), f"s{i}", float(p), int(v)) for i, (t, p, v) in enumerate(zip(at, score, y, strict=True))], "ts long, symbol string, p_long double, y int").repartition(7)
    want = [(int(t), s) for t, s in sorted((t, f"s{i}") for i, t in enumerate(at))]
    assert [(r["ts"], r["symbol"]) for r in validation.numbered(rows, "r").orderBy("r").collect()] == want
    assert sorted(r["r"] for r in validation.numbered(rows, "r").collect()) == list(range(1, 501))
    pairs = [(a > b) + (a == b) / 2 for a in score[y == 1] for b in score[y == 0]]
    steps = sorted(set(score), reverse=True)
    precision = sum(((score == s) & (y == 1)).sum() * (y[score >= s].mean()) for s in steps) / y.sum()
    for stretches in (1, 2, 256):
        got = metrics.ranking(rows, stretches).first()
        assert abs(got["roc_auc"] - np.mean(pairs)) < 1e-12 and abs(got["average_precision"] - precision) < 1e-12
    assert metrics.ranking(rows.limit(0)).first()["roc_auc"] is None
