"""First-order recursions (exponential averages) per symbol: one grouped pass for all of a timeframe.

A recursion needs a symbol's bars in order, which built-in windows cannot express in linear time. Only bars, never events, come
this way; a symbol's bars of many years are a few megabytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def wilder(x: pd.Series, length: int, least: int = 0) -> pd.Series:
    return x.ewm(alpha=1.0 / length, adjust=False, min_periods=least).mean()


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def main_averages(bars: pd.DataFrame) -> dict[str, pd.Series]:
    return {"ema12": ema(bars["close"], 12), "ema48": ema(bars["close"], 48), "avg_gain": wilder(bars["dc"].clip(lower=0.0), 14, 14), "avg_loss": wilder((-bars["dc"]).clip(lower=0.0), 14, 14), "rvol_ema48": ema(bars["realized_vol_1h"], 48)}


def htf_averages(bars: pd.DataFrame) -> dict[str, pd.Series]:
    reach = wilder(bars["tr"], 14)
    plus, minus = 100 * ratio(wilder(bars["plus_dm"], 14), reach), 100 * ratio(wilder(bars["minus_dm"], 14), reach)
    return {"ema21": ema(bars["close"], 21), "adx": wilder(100 * ratio((plus - minus).abs(), plus + minus), 14)}


def with_averages(df: DataFrame, make, names: list[str]) -> DataFrame:
    """df with the recursions of make(bars of one symbol, in order); missing values are NULL."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable").reset_index(drop=True)
        return part.assign(**make(part))[schema.names]

    return df.groupBy("symbol").applyInPandas(run, schema)


MAIN_NAMES = ["ema12", "ema48", "avg_gain", "avg_loss", "rvol_ema48"]
HTF_NAMES = ["ema21", "adx"]


def _step(value: str, y: str, w: str, alpha: float) -> list[str]:
    """SQL of one step of an average y with weight w: a NULL value leaves y and lets its weight fade."""
    faded = f"{w} * {1 - alpha!r}"
    return [f"CASE WHEN {value} IS NULL THEN {y} WHEN {y} IS NULL THEN {value} ELSE ({faded} * {y} + {alpha!r} * {value}) / ({faded} + {alpha!r}) END", f"CASE WHEN {value} IS NULL AND {y} IS NOT NULL THEN {faded} ELSE 1.0 END"]


def duckdb(source: str, averages: dict[str, tuple[str, float]], name: str) -> str:
    """A recursive table expression (symbol, rn, one column an average) over source, which has symbol and rn; averages: column to (value, alpha)."""
    start = ", ".join(f"{v} AS {n}, CAST(1.0 AS DOUBLE) AS w_{n}" for n, (v, _) in averages.items())
    step = ", ".join(f"{a}, {b}" for n, (v, alpha) in averages.items() for a, b in [_step(f"s.{v}", f"r.{n}", f"r.w_{n}", alpha)])
    return f"{name} AS (SELECT symbol, rn, {start} FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {step} FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"
