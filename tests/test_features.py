"""Feature frame against pandas statements of the formulas; causality, order and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features as fx
from tidemark.operators import feature_frame

HOUR = 3_600_000
T0 = 1_704_067_200_000


def market(hours=260, symbols=("AAA", "BBB", "CCC"), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(symbols):
        close = 100 * (k + 1) * np.exp(np.cumsum(rng.normal(scale=0.01, size=hours)))
        opened = np.concatenate([[close[0]], close[:-1]]) * (1 + rng.normal(scale=0.001, size=hours))
        high, low = np.maximum(opened, close) * (1 + rng.uniform(0, 0.01, hours)), np.minimum(opened, close) * (1 - rng.uniform(0, 0.01, hours))
        rows.append(pd.DataFrame({"symbol": s, "ts": T0 + HOUR * np.arange(1, hours + 1), "open": opened, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, hours).astype(float)}))
    return pd.concat(rows, ignore_index=True)


def frames(spark, main):
    htf = main.assign(b=(main.ts - T0 - HOUR) // (4 * HOUR)).groupby(["symbol", "b"]).agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum")).reset_index()
    htf["ts"] = T0 + (htf.b + 1) * 4 * HOUR
    side = main[main.ts % (8 * HOUR) == 0]
    funding = side[["symbol", "ts"]].assign(funding_rate=np.sin(side.ts / HOUR) / 1000)
    premium = main[["symbol", "ts"]].assign(premium_index_close=np.cos(main.ts / HOUR) / 500)
    interest = main[["symbol", "ts"]].assign(open_interest=main.volume.groupby(main.symbol).cumsum())
    return [spark.createDataFrame(x) for x in (main, htf[["symbol", "ts", "open", "high", "low", "close", "volume"]], funding, premium, interest)], htf


@pytest.fixture(scope="module")
def built(spark):
    main = market()
    dfs, htf = frames(spark, main)
    out = feature_frame.build(*dfs, benchmark="AAA").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    return main, htf, out


def atr(x, n):
    prev = x.close.shift(1)
    tr = pd.concat([x.high - x.low, (x.high - prev).abs(), (x.low - prev).abs()], axis=1).max(axis=1)
    return tr.rolling(n).mean()


def slope(x, n):
    i = np.arange(n) - (n - 1) / 2
    return x.rolling(n).apply(lambda y: (i * (y - y.mean())).sum() / (i**2).sum(), raw=True)


def zs(x, n):
    return (x - x.rolling(n).mean()) / x.rolling(n).std()


def statement(x):
    """Formulas of one symbol's bars, in pandas."""
    c, h, lo, v = x.close, x.high, x.low, x.volume
    ret = np.log(c / c.shift(1))
    rvol = ret.rolling(24).std()
    a14, e12, e48 = atr(x, 14), c.ewm(span=12, adjust=False).mean(), c.ewm(span=48, adjust=False).mean()
    efs = (e12 - e48) / e48
    d = c.diff()
    gain, loss = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    vwap = (((h + lo + c) / 3) * v).rolling(24).sum() / v.rolling(24).sum()
    te = (c - c.shift(24)).abs() / d.abs().rolling(24).sum()
    lab = pd.Series(np.select([rvol > 1.2 * rvol.rolling(96).mean(), rvol < 0.8 * rvol.rolling(96).mean()], [2, 0], 1), index=c.index)
    run = lab.groupby((lab != lab.shift()).cumsum()).cumcount() + 1
    day = (x.ts // 86_400_000)
    m20, s20 = c.rolling(20).mean(), c.rolling(20).std()
    hi48, lo48 = h.rolling(48).max(), lo.rolling(48).min()
    return {
        "return_1h_12": np.log(c / c.shift(12)), "ema_fast_slow": efs, "rsi_1h": 100 - 100 / (1 + gain / loss.replace(0, np.nan)), "linear_regression_slope_atr_1h_24": slope(c, 24) / a14, "slope_acceleration_1h_12_24": (slope(c, 12) - slope(c, 24)) / a14,
        "trend_persistence_score_12": np.sign(d).rolling(12).mean(), "trend_efficiency_24h": te, "ema_slope_acceleration_1h": efs - efs.shift(3), "realized_vol_1h": rvol, "atr_ratio_1h": a14 / atr(x, 100), "volatility_regime_change_1h": atr(x, 6) / atr(x, 48),
        "range_compression_1h": (h.rolling(12).max() - lo.rolling(12).min()) / (hi48 - lo48), "volume_ratio_1h": v / v.rolling(24).mean(), "volume_zscore_1h": zs(v, 168), "dollar_volume_zscore_1h": zs(np.log1p(c * v), 168), "vol_of_vol_1h": rvol.rolling(12).std(),
        "realized_vol_vs_ema": rvol / rvol.ewm(span=48, adjust=False).mean() - 1, "volatility_regime_stability": run.clip(upper=48) / 48, "high_vol_stress_indicator": ((a14 > 1.1 * atr(x, 48)) & (rvol > rvol.rolling(96).quantile(0.75))).astype(float),
        "vol_regime_classification": (rvol > rvol.rolling(96).quantile(0.33)).astype(float) + (rvol > rvol.rolling(96).quantile(0.67)).astype(float), "distance_to_session_high_1h": (h.groupby(day).cummax() - c) / a14, "range_center_distance_atr_1h_48": (c - (hi48 + lo48) / 2) / a14,
        "flat_efficiency_1h_24": 1 - te.clip(0, 1), "mean_reversion_pressure_1h": -((((c - lo48) / (hi48 - lo48)) - 0.5) * 2).clip(-1, 1), "zscore_vs_vwap_1h": (c - vwap) / (c - vwap).rolling(24).std(), "bollinger_percent_b_1h_20": (c - (m20 - 2 * s20)) / (4 * s20), "bollinger_bandwidth_atr_1h_20": 4 * s20 / a14,
    }


def test_main_features_match_pandas(built):
    main, _, out = built
    for s, x in main.groupby("symbol"):
        x, got = x.reset_index(drop=True), out[out.symbol == s].reset_index(drop=True)
        for name, want in statement(x).items():
            np.testing.assert_allclose(got[name].astype(float), want.astype(float), rtol=1e-7, atol=1e-9, err_msg=name)


def test_relative_and_cross_section(built):
    main, _, out = built
    wide = main.pivot(index="ts", columns="symbol", values="close")
    ret, r24 = np.log(wide / wide.shift(1)), np.log(wide / wide.shift(24))
    beta = ret["BBB"].rolling(24).cov(ret["AAA"]) / ret["AAA"].rolling(24).var()
    b = out[out.symbol == "BBB"].set_index("ts")
    np.testing.assert_allclose(b.beta_to_btc_24h, beta, rtol=1e-7)
    np.testing.assert_allclose(b.residual_return_24h, r24["BBB"] - beta * r24["AAA"], rtol=1e-6, atol=1e-9)
    assert (out[out.symbol == "AAA"][["relative_strength_vs_btc_24h", "beta_to_btc_24h", "residual_return_24h", "mcc_sign_agreement_btc_24h"]] == [0, 1, 0, 1]).all().all()
    i = 200
    up = [(ret["BBB"].iloc[i - 23 : i + 1] > 0).to_numpy(), (ret["AAA"].iloc[i - 23 : i + 1] > 0).to_numpy()]
    assert b.mcc_sign_agreement_btc_24h.iloc[i] == pytest.approx(np.corrcoef(*up)[0, 1])
    efs = out.pivot(index="ts", columns="symbol", values="ema_fast_slow")
    rank = (efs.rank(axis=1) - 1) / 2
    np.testing.assert_allclose(out.pivot(index="ts", columns="symbol", values="cross_sectional_rank_ema_fast_slow_1h"), rank)
    np.testing.assert_allclose(b.market_breadth_ema_fast_slow_1h, (efs > 0).mean(axis=1))
    np.testing.assert_allclose(b.market_directional_pressure_1h, ((efs > 0).mean(axis=1) - 0.5) * 2, atol=1e-12)


def test_higher_timeframe(built):
    _, htf, out = built
    x = htf[htf.symbol == "CCC"].reset_index(drop=True)
    c, h, lo, v = x.close, x.high, x.low, x.volume
    a14 = atr(x, 14)
    up, down = h.diff(), -lo.diff()
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean()
    prev = c.shift(1)
    reach = wilder(pd.concat([h - lo, (h - prev).abs(), (lo - prev).abs()], axis=1).max(axis=1))
    p, m = 100 * wilder(pd.Series(np.where((up > down) & (up > 0), up, 0.0))) / reach, 100 * wilder(pd.Series(np.where((down > up) & (down > 0), down, 0.0))) / reach
    adx = wilder(100 * (p - m).abs() / (p + m).replace(0, np.nan))
    hi, low = h.rolling(14).max(), lo.rolling(14).min()
    vw = (((h + lo + c) / 3) * v).rolling(20).sum() / v.rolling(20).sum()
    breakout = pd.Series(np.select([c > hi.shift(1), c < low.shift(1)], [(c - hi.shift(1)) / a14, -(low.shift(1) - c) / a14], 0.0))
    want = pd.DataFrame({"ts": x.ts, "adx_4h": adx, "return_4h_3": np.log(c / c.shift(3)), "ema_slope_4h": slope(c.ewm(span=21, adjust=False).mean(), 6) / a14, "breakout_quality_4h": breakout, "donchian_width_change_4h": ((hi - low) / a14).diff(3), "zscore_vs_vwap_4h": zs(c - vw, 20)})
    want.iloc[:, 1:] = want.iloc[:, 1:].shift(1)
    got = out[out.symbol == "CCC"].reset_index(drop=True)
    merged = pd.merge_asof(got[["ts"]], want, on="ts")
    for name in want.columns[1:]:
        np.testing.assert_allclose(got[name].astype(float), merged[name], rtol=1e-7, atol=1e-9, err_msg=name)


def test_no_look_ahead_and_no_order(spark, built):
    """Cutting the bars at a time changes nothing before it; neither does the order of rows."""
    main, _, out = built
    cut = T0 + HOUR * 200
    dfs, _ = frames(spark, main[main.ts <= cut])
    early = feature_frame.build(*[d.orderBy(F.rand(3)) for d in dfs], benchmark="AAA").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(early, out[out.ts <= cut].reset_index(drop=True), rtol=1e-9, atol=1e-10)


def test_edges(spark):
    flat = market(60, ("ONE",)).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    dfs, _ = frames(spark, flat)
    names = ["rsi_1h", "bollinger_percent_b_1h_20", "cross_sectional_rank_ema_fast_slow_1h", "beta_to_btc_24h", "return_1h_6", "ema_fast_slow"]
    out = feature_frame.build(*dfs, benchmark="NONE", request=names).toPandas().sort_values("ts")
    assert list(out.columns[7:]) == sorted(names)
    assert out.rsi_1h.isna().all() and out.bollinger_percent_b_1h_20.isna().all() and out.beta_to_btc_24h.isna().all()
    assert (out.cross_sectional_rank_ema_fast_slow_1h == 0.5).all() and (out.ema_fast_slow == 0).all() and out.return_1h_6.isna().sum() == 6
    empty = [x.limit(0) for x in dfs]
    assert feature_frame.build(*empty, benchmark="ONE").count() == 0


def test_request():
    assert len(fx.NAMES) == len(set(fx.NAMES)) == 97 and len(fx.BLOCKS) == 12
    assert fx.resolve() == sorted(fx.NAMES)
    assert "vol_ratio" not in fx.resolve(fx.Request(exclude_blocks=("interactions",)))
    without = fx.resolve(fx.Request(exclude=("realized_vol_1h", "vol_ratio", "market_pressure_x_vol_regime")))
    assert not set(without) & {*fx.NEEDS_VOL, "ema_fast_slow_x_vol_of_vol", "signal_x_high_vol_stress"}
    for bad in (fx.Request("none"), fx.Request(include=("x",)), fx.Request(exclude_blocks=("x",)), ["x"], ["vol_ratio"]):
        with pytest.raises(ValueError):
            fx.resolve(bad)


def test_pruned(spark, built):
    """A feature that needs no recursion's neighbours keeps windows of others out of the plan."""
    dfs, _ = frames(spark, market(30))
    few = feature_frame.build(*dfs, benchmark="AAA", request=["volume_24h"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in few and "regr_slope" not in few and "adx" not in few


@pytest.mark.parametrize(("block", "scans", "python"), [("time_context", 1, False), ("funding", 2, False), ("structure", 1, False), ("htf", 2, True), ("momentum", 1, True)])
def test_plan_holds_what_the_request_needs(spark, block, scans, python):
    """Tables, joins and recursions that no requested feature rests on are not in the plan."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = feature_frame.from_events(events, "purchase", fx.BLOCKS[block])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == scans
    assert ("FlatMapGroupsInPandas" in plan) == python


def test_needed_follows_levels_down():
    which = [{"a": "x + 1", "b": "y"}, {"c": "a * 2", "a": "a + b"}, {"d": "c", "e": "z"}]
    assert feature_frame.needed(which, {"d"}) == ([{"a": "x + 1"}, {"c": "a * 2"}, {"d": "c"}], {"x"})
    assert feature_frame.needed(which, {"a"})[1] == {"x", "y"}
    assert feature_frame.needed(which, {"q"}) == ([], {"q"})
