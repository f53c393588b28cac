"""The feature catalogue: 97 named outputs in 12 blocks, as levels of column expressions.

A level may use everything of the levels before it. Helper columns are cheap: Catalyst drops those that no
requested feature needs, and puts the windows of one level into one sort. Exponential averages are recursions; they come from
``operators.recursive`` between two levels.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .dialect import Dialect, clip, div, flag, full, lag, log_ratio, rank_share, rows, share_positive, slope, zscore

DAY_MS, HOUR_MS = 86_400_000, 3_600_000

# The names by block.
BLOCKS: dict[str, list[str]] = {
    "momentum": "return_1h_6 return_1h_12 return_1h_24 ema_fast_slow rsi_1h linear_regression_slope_atr_1h_12 linear_regression_slope_atr_1h_24 trend_persistence_score_12 trend_persistence_score_24 trend_efficiency_24h slope_acceleration_1h_12_24 ema_slope_acceleration_1h".split(),
    "regime": "realized_vol_1h atr_ratio_1h volatility_regime_change_1h range_compression_1h volatility_acceleration_1h volume_24h volume_ratio_1h volume_zscore_1h dollar_volume_zscore_1h vol_of_vol_1h realized_vol_vs_ema volatility_regime_stability high_vol_stress_indicator vol_regime_classification".split(),
    "structure": "price_position_1h distance_to_support_1h distance_to_resistance_1h distance_to_session_high_1h distance_to_session_low_1h range_position_1h_48 range_width_atr_1h_48 range_center_distance_atr_1h_48 flat_efficiency_1h_24 mean_reversion_pressure_1h zscore_vs_vwap_1h bollinger_percent_b_1h_20 bollinger_bandwidth_atr_1h_20".split(),
    "time_context": "hour_sin_1h hour_cos_1h is_weekend_1h".split(),
    "funding": "funding_rate_8h funding_rate_zscore_7d funding_rate_change_24h longs_overheated_1h shorts_overheated_1h".split(),
    "premium_index": "premium_index_1h premium_index_zscore_7d premium_index_change_24h crowded_longs_score_1h crowded_shorts_score_1h".split(),
    "open_interest": "open_interest_zscore_7d open_interest_change_pct_8h open_interest_change_pct_24h open_interest_funding_crowding_1h".split(),
    "btc_relative": "relative_strength_vs_btc_24h beta_to_btc_24h residual_return_24h mcc_sign_agreement_btc_24h".split(),
    "cross_sectional": "cross_sectional_rank_ema_fast_slow_1h cross_sectional_rank_4h".split(),
    "market_context": "market_breadth_ema_fast_slow_1h market_breadth_pos_return_4h_3 market_dispersion_return_4h_3 market_breadth_pos_return_4h_14 market_mean_return_4h_14 market_avg_ema_slope_4h market_abs_avg_ema_slope_4h".split(),
    "htf": "return_4h_1 return_4h_3 return_4h_7 return_4h_14 realized_vol_4h_returns_20 adx_4h price_position_4h distance_to_rolling_high_4h distance_to_rolling_low_4h breakout_quality_4h donchian_width_atr_4h donchian_width_change_4h ema_slope_4h zscore_vs_vwap_4h".split(),
    "interactions": "vol_ratio delta_market_breadth_ema_fast_slow_1h market_breadth_ema_fast_slow_1h_zscore ema_fast_slow_x_market_breadth_ema_fast_slow_1h market_directional_pressure_1h signal_market_agreement_1h counter_market_penalty_1h trend_efficiency_24h_x_volatility_regime_change_1h trend_alignment_1h_4h breakout_quality_4h_x_volume_ratio_1h ema_fast_slow_x_vol_of_vol trend_efficiency_x_vol_stability market_pressure_x_vol_regime signal_x_high_vol_stress".split(),
}
NAMES: list[str] = [n for names in BLOCKS.values() for n in names]
BLOCK_OF = {n: b for b, names in BLOCKS.items() for n in names}
HTF_CROSS = ["cross_sectional_rank_4h", *BLOCKS["market_context"][1:]]
#: Left out in silence when realized_vol_1h is not asked for.
NEEDS_VOL = ["vol_of_vol_1h", "realized_vol_vs_ema", "volatility_regime_stability", "high_vol_stress_indicator", "vol_regime_classification"]
#: Of the interactions, those that are left out in silence when an input is missing; the others raise.
INTERACTION_INPUTS: dict[str, list[str]] = {
    "vol_ratio": ["realized_vol_1h", "realized_vol_4h_returns_20"],
    "delta_market_breadth_ema_fast_slow_1h": ["market_breadth_ema_fast_slow_1h"],
    "market_breadth_ema_fast_slow_1h_zscore": ["market_breadth_ema_fast_slow_1h"],
    "ema_fast_slow_x_market_breadth_ema_fast_slow_1h": ["ema_fast_slow", "market_breadth_ema_fast_slow_1h"],
    "market_directional_pressure_1h": ["market_breadth_ema_fast_slow_1h"],
    "signal_market_agreement_1h": ["ema_fast_slow", "market_breadth_ema_fast_slow_1h"],
    "counter_market_penalty_1h": ["ema_fast_slow", "market_breadth_ema_fast_slow_1h"],
    "trend_efficiency_24h_x_volatility_regime_change_1h": ["trend_efficiency_24h", "volatility_regime_change_1h"],
    "trend_alignment_1h_4h": ["ema_fast_slow", "ema_slope_4h"],
    "breakout_quality_4h_x_volume_ratio_1h": ["breakout_quality_4h", "volume_ratio_1h"],
    "ema_fast_slow_x_vol_of_vol": ["ema_fast_slow", "vol_of_vol_1h"],
    "trend_efficiency_x_vol_stability": ["trend_efficiency_24h", "volatility_regime_stability"],
    "market_pressure_x_vol_regime": ["market_breadth_ema_fast_slow_1h", "vol_regime_classification"],
    "signal_x_high_vol_stress": ["ema_fast_slow", "high_vol_stress_indicator"],
}
SKIPPED = ["ema_fast_slow_x_vol_of_vol", "trend_efficiency_x_vol_stability", "signal_x_high_vol_stress"]

# The named profiles.
PROFILES: dict[str, list[str]] = {
    "all": NAMES,
    "empty": [],
    "base_only": [
        "realized_vol_1h",
        "ema_fast_slow",
        "return_1h_24",
        "linear_regression_slope_atr_1h_24",
        "trend_efficiency_24h",
        "atr_ratio_1h",
        "range_compression_1h",
        "price_position_1h",
        "relative_strength_vs_btc_24h",
        "residual_return_24h",
        "return_4h_3",
        "return_4h_14",
        "ema_slope_4h",
        "realized_vol_4h_returns_20",
        "market_breadth_pos_return_4h_3",
        "market_dispersion_return_4h_3",
        "zscore_vs_vwap_4h",
        "vol_ratio",
        "price_position_4h",
        "adx_4h",
    ],
}


@dataclass(frozen=True)
class Request:
    """What to compute: a profile, plus names, minus names, minus blocks."""

    profile: str = "all"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_blocks: tuple[str, ...] = ()


def resolve(request: Request | Iterable[str] = Request()) -> list[str]:
    """The sorted names of a request; unknown profiles, names and blocks raise, missing inputs of interactions too."""
    if isinstance(request, Request):
        if request.profile not in PROFILES:
            _unknown("profile", {request.profile})
        if bad := set(request.exclude_blocks) - set(BLOCKS):
            _unknown("blocks", bad)
        names = {*PROFILES[request.profile], *request.include} - set(request.exclude) - {n for b in request.exclude_blocks for n in BLOCKS[b]}
        asked = {*request.include, *request.exclude}
    else:
        names = asked = set(request)
    if bad := asked - set(NAMES):
        _unknown("features", bad)
    if "realized_vol_1h" not in names:
        names -= set(NEEDS_VOL)
    for name, inputs in INTERACTION_INPUTS.items():
        if name in names and (missing := [x for x in inputs if x not in names]):
            if name not in SKIPPED:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            names.discard(name)
    return sorted(names)


def _unknown(what: str, names: set[str]):
    raise ValueError(f"unknown {what}: {', '.join(sorted(names))}")


def true_range() -> str:
    # the first bar has no close before it; CASE instead of greatest, whose NULL rules differ between engines
    return "CASE WHEN lc IS NULL THEN high - low ELSE greatest(high - low, abs(high - lc), abs(low - lc)) END"


def main_before(d: Dialect) -> list[dict[str, str]]:
    """Levels on base bars up to the volatility that a recursion needs."""
    return [
        {"lc": lag("close"), "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"},
        {"tr": true_range(), "ret1": log_ratio("close", "lc"), "dc": "close - lc"},
        {"realized_vol_1h": full("stddev_samp", "ret1", 24)},
    ]


def main_after(d: Dialect, benchmark: str) -> list[dict[str, str]]:
    """Levels on base bars with ema12, ema48, avg_gain, avg_loss and rvol_ema48. benchmark_close is the benchmark's close at the same time."""
    session = "(PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    is_benchmark = f"symbol = '{benchmark}'"
    up, down = "ret1 > 0", "ret1 <= 0"
    pair = "ret1 IS NOT NULL AND bret1 IS NOT NULL"
    over24 = rows(24)
    count = lambda c: f"sum({flag(f'{pair} AND {c}')}) OVER {over24}"
    return [
        {
            "sgn": "sign(dc)", "adc": "abs(dc)", "tpv": "(high + low + close) / 3.0 * volume", "ldv": f"ln(1 + {clip('close * volume', 0.0)})", "day": f"floor(ts / {DAY_MS}.0)",
            "blc": lag("benchmark_close"), "b24": lag("benchmark_close", 24), "oi": d.filled("open_interest"), "hour": f"floor(ts / {HOUR_MS}.0) - 24 * floor(ts / {DAY_MS}.0)",
        },
        {
            **{f"atr{n}": full("avg", "tr", n) for n in (6, 14, 48, 100)},
            **{f"high{n}": full("max", "high", n) for n in (12, 24, 48)},
            **{f"low{n}": full("min", "low", n) for n in (12, 24, 48)},
            "slope12": slope("close", 12), "slope24": slope("close", 24), "path24": full("sum", "adc", 24), "m20": full("avg", "close", 20), "s20": full("stddev_samp", "close", 20),
            "vwap24": div(full("sum", "tpv", 24), full("sum", "volume", 24)), "session_high": f"max(high) OVER {session}", "session_low": f"min(low) OVER {session}",
            "rvol_m96": full("avg", "realized_vol_1h", 96), "q33": d.quantile("realized_vol_1h", 0.33, 96), "q67": d.quantile("realized_vol_1h", 0.67, 96), "q75": d.quantile("realized_vol_1h", 0.75, 96),
            "bret1": log_ratio("benchmark_close", "blc"), "bret24": log_ratio("benchmark_close", "b24"),
        },
        {
            **{f"return_1h_{k}": log_ratio("close", lag("close", k)) for k in (6, 12, 24)},
            "ema_fast_slow": div("ema12 - ema48", "ema48"),
            "rsi_1h": f"100.0 - 100.0 / (1.0 + {div('avg_gain', 'avg_loss')})",
            "linear_regression_slope_atr_1h_12": div("slope12", "atr14"),
            "linear_regression_slope_atr_1h_24": div("slope24", "atr14"),
            "slope_acceleration_1h_12_24": div("slope12 - slope24", "atr14"),
            "trend_persistence_score_12": full("avg", "sgn", 12),
            "trend_persistence_score_24": full("avg", "sgn", 24),
            "trend_efficiency_24h": div(f"abs(close - {lag('close', 24)})", "path24"),
            "atr_ratio_1h": div("atr14", "atr100"),
            "volatility_regime_change_1h": div("atr6", "atr48"),
            "range_compression_1h": div("high12 - low12", "high48 - low48"),
            "volume_24h": full("sum", "volume", 24),
            "volume_ratio_1h": div("volume", full("avg", "volume", 24)),
            "volume_zscore_1h": zscore("volume", 168),
            "dollar_volume_zscore_1h": zscore("ldv", 168),
            "vol_of_vol_1h": full("stddev_samp", "realized_vol_1h", 12),
            "realized_vol_vs_ema": div("realized_vol_1h - rvol_ema48", "rvol_ema48"),
            "vol_label": "CASE WHEN realized_vol_1h > 1.2 * rvol_m96 THEN 2 WHEN realized_vol_1h < 0.8 * rvol_m96 THEN 0 ELSE 1 END",
            "high_vol_stress_indicator": flag("atr14 > 1.1 * atr48 AND realized_vol_1h > q75"),
            "vol_regime_classification": "CASE WHEN realized_vol_1h > q33 THEN 1 ELSE 0 END + CASE WHEN realized_vol_1h > q67 THEN 1 ELSE 0 END",
            "price_position_1h": div("close - low24", "high24 - low24"),
            "distance_to_support_1h": div("close - low24", "atr14"),
            "distance_to_resistance_1h": div("high24 - close", "atr14"),
            "distance_to_session_high_1h": div("session_high - close", "atr14"),
            "distance_to_session_low_1h": div("close - session_low", "atr14"),
            "range_position_1h_48": div("close - low48", "high48 - low48"),
            "range_width_atr_1h_48": div("high48 - low48", "atr14"),
            "range_center_distance_atr_1h_48": div("close - (high48 + low48) / 2.0", "atr14"),
            "vwap_gap": "close - vwap24",
            "bollinger_percent_b_1h_20": div("close - (m20 - 2.0 * s20)", "(m20 + 2.0 * s20) - (m20 - 2.0 * s20)"),
            "bollinger_bandwidth_atr_1h_20": div("(m20 + 2.0 * s20) - (m20 - 2.0 * s20)", "atr14"),
            "hour_sin_1h": "sin(2.0 * pi() * hour / 24.0)",
            "hour_cos_1h": "cos(2.0 * pi() * hour / 24.0)",
            "is_weekend_1h": flag("(day + 3) - 7 * floor((day + 3) / 7.0) >= 5"),
            "funding_rate_8h": "funding_rate",
            "funding_rate_zscore_7d": zscore("funding_rate", 168),
            "funding_rate_change_24h": f"funding_rate - {lag('funding_rate', 24)}",
            "premium_index_1h": "premium_index_close",
            "premium_index_zscore_7d": zscore("premium_index_close", 168),
            "premium_index_change_24h": f"premium_index_close - {lag('premium_index_close', 24)}",
            "open_interest_zscore_7d": zscore("open_interest", 168),
            "open_interest_change_pct_8h": f"{div('oi', lag('oi', 8))} - 1",
            "open_interest_change_pct_24h": f"{div('oi', lag('oi', 24))} - 1",
            "beta": f"CASE WHEN count(ret1 * bret1) OVER {over24} = 24 AND count(bret1) OVER {over24} = 24 THEN {div(f'covar_samp(ret1, bret1) OVER {over24}', f'var_samp(bret1) OVER {over24}')} END",
            "tp": count(f"{up} AND bret1 > 0"), "tn": count(f"{down} AND bret1 <= 0"), "fp": count(f"{down} AND bret1 > 0"), "fn": count(f"{up} AND bret1 <= 0"),
        },
        {
            "ema_slope_acceleration_1h": f"ema_fast_slow - {lag('ema_fast_slow', 3)}",
            "volatility_acceleration_1h": f"volatility_regime_change_1h - {lag('volatility_regime_change_1h', 3)}",
            "label_new": f"CASE WHEN vol_label = {lag('vol_label')} THEN 0 ELSE 1 END",
            "flat_efficiency_1h_24": f"1.0 - {clip('trend_efficiency_24h', 0.0, 1.0)}",
            "mean_reversion_pressure_1h": f"-({clip('(range_position_1h_48 - 0.5) * 2.0', -1.0, 1.0)})",
            "zscore_vs_vwap_1h": div("vwap_gap", full("stddev_samp", "vwap_gap", 24)),
            "longs_overheated_1h": clip("funding_rate_zscore_7d", 0.0),
            "shorts_overheated_1h": clip("-funding_rate_zscore_7d", 0.0),
            "crowded_longs_score_1h": f"({clip('premium_index_zscore_7d', 0.0)}) * ({clip('funding_rate_zscore_7d', 0.0)})",
            "crowded_shorts_score_1h": f"({clip('-premium_index_zscore_7d', 0.0)}) * ({clip('-funding_rate_zscore_7d', 0.0)})",
            "open_interest_funding_crowding_1h": "open_interest_change_pct_24h * funding_rate_zscore_7d",
            "relative_strength_vs_btc_24h": f"CASE WHEN {is_benchmark} THEN 0.0 ELSE return_1h_24 - bret24 END",
            "beta_to_btc_24h": f"CASE WHEN {is_benchmark} THEN 1.0 ELSE beta END",
            "residual_return_24h": f"CASE WHEN {is_benchmark} THEN 0.0 ELSE return_1h_24 - beta * bret24 END",
            "mcc_sign_agreement_btc_24h": f"CASE WHEN {is_benchmark} THEN 1.0 WHEN rn >= 24 AND tp + tn + fp + fn >= 12 THEN {div('tp * tn - fp * fn', 'sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} END",
            "cross_sectional_rank_ema_fast_slow_1h": rank_share("ema_fast_slow"),
            "market_breadth_ema_fast_slow_1h": share_positive("ema_fast_slow"),
        },
        {"label_run": "sum(label_new) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"volatility_regime_stability": "least(row_number() OVER (PARTITION BY symbol, label_run ORDER BY ts), 48) / 48.0"},
    ]


def htf_before(d: Dialect) -> list[dict[str, str]]:
    return [
        {"lc": lag("close"), "lh": lag("high"), "ll": lag("low"), "rn": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"},
        {"tr": true_range(), "ret1": log_ratio("close", "lc"), "plus_dm": "CASE WHEN high - lh > ll - low AND high - lh > 0 THEN high - lh ELSE 0.0 END", "minus_dm": "CASE WHEN ll - low > high - lh AND ll - low > 0 THEN ll - low ELSE 0.0 END", "tpv": "(high + low + close) / 3.0 * volume"},
    ]


def htf_after(d: Dialect) -> list[dict[str, str]]:
    """Levels on the higher timeframe with ema21 and adx; outputs are lagged by a bar before they meet other symbols."""
    lagged = BLOCKS["htf"]
    return [
        {"atr14": full("avg", "tr", 14), "high14": full("max", "high", 14), "low14": full("min", "low", 14), "ema_slope": slope("ema21", 6), "vwap20": div(full("sum", "tpv", 20), full("sum", "volume", 20))},
        {"ph": lag("high14"), "pl": lag("low14"), "gap": "close - vwap20", "width": div("high14 - low14", "atr14")},
        {
            **{f"raw_return_4h_{k}": log_ratio("close", lag("close", k)) for k in (1, 3, 7, 14)},
            "raw_realized_vol_4h_returns_20": full("stddev_samp", "ret1", 20),
            "raw_adx_4h": "adx",
            "raw_price_position_4h": div("close - low14", "high14 - low14"),
            "raw_distance_to_rolling_high_4h": div("close - high14", "atr14"),
            "raw_distance_to_rolling_low_4h": div("close - low14", "atr14"),
            "raw_breakout_quality_4h": f"CASE WHEN close > ph THEN {div('close - ph', 'atr14')} WHEN close < pl THEN -{div('pl - close', 'atr14')} ELSE 0.0 END",
            "raw_donchian_width_atr_4h": "width",
            "raw_donchian_width_change_4h": f"width - {lag('width', 3)}",
            "raw_ema_slope_4h": div("ema_slope", "atr14"),
            "raw_zscore_vs_vwap_4h": zscore("gap", 20),
        },
        {n: lag(f"raw_{n}") for n in lagged},
        {
            "cross_sectional_rank_4h": rank_share("return_4h_3"),
            "market_breadth_pos_return_4h_3": share_positive("return_4h_3"),
            "market_dispersion_return_4h_3": "stddev_pop(return_4h_3) OVER (PARTITION BY ts)",
            "market_breadth_pos_return_4h_14": share_positive("return_4h_14"),
            "market_mean_return_4h_14": "avg(return_4h_14) OVER (PARTITION BY ts)",
            "market_avg_ema_slope_4h": "avg(ema_slope_4h) OVER (PARTITION BY ts)",
            "market_abs_avg_ema_slope_4h": "avg(abs(ema_slope_4h)) OVER (PARTITION BY ts)",
        },
    ]


def interactions(d: Dialect) -> list[dict[str, str]]:
    """Levels on base bars after the higher timeframe has joined them."""
    b, e = "market_breadth_ema_fast_slow_1h", "ema_fast_slow"
    p = f"(({b} - 0.5) * 2.0)"
    return [
        {
            "vol_ratio": div("realized_vol_1h", "realized_vol_4h_returns_20 / sqrt(4.0)"),
            f"delta_{b}": f"{b} - {lag(b)}",
            f"{b}_zscore": zscore(b, 96),
            f"{e}_x_{b}": f"{e} * {b}",
            "market_directional_pressure_1h": p,
            "signal_market_agreement_1h": f"{e} * {p}",
            "counter_market_penalty_1h": f"abs({e}) * ({clip(f'-sign({e}) * {p}', 0.0)})",
            "trend_efficiency_24h_x_volatility_regime_change_1h": "trend_efficiency_24h * volatility_regime_change_1h",
            "trend_alignment_1h_4h": f"{e} * ema_slope_4h",
            "breakout_quality_4h_x_volume_ratio_1h": "breakout_quality_4h * volume_ratio_1h",
            "ema_fast_slow_x_vol_of_vol": f"{e} * vol_of_vol_1h",
            "trend_efficiency_x_vol_stability": "trend_efficiency_24h * volatility_regime_stability",
            "market_pressure_x_vol_regime": f"{p} * (vol_regime_classification - 1)",
            "signal_x_high_vol_stress": f"{e} * high_vol_stress_indicator",
        }
    ]
