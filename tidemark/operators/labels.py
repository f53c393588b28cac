"""Volatility-scaled triple-barrier labels as levels of column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect, clip, full, lag
from ..functions.features import true_range
from .feature_frame import levels


@dataclass(frozen=True)
class Barriers:
    base: int = 12
    shortest: int = 8
    longest: int = 20
    adaptive: bool = True
    vol_low: float = 0.005
    vol_high: float = 0.025
    dynamic: bool = True
    atr_multiple: float = 1.25
    vol_multiple: float = 0.75
    least: float = 0.0075
    most: float = 0.06
    take_to_stop: float = 2.0
    fixed_stop: float = 0.015
    fixed_take: float = 0.03
    taker: float = 0.0004
    slippage: float = 0.0003

    @property
    def look_ahead(self) -> int:
        """The most bars that a label may look ahead, and so the purge gap."""
        return max(self.base, self.longest) if self.adaptive else self.base


def horizon(b: Barriers, d: Dialect) -> str:
    if not b.adaptive or b.vol_high <= b.vol_low:
        return str(b.base)
    share = clip(f"(abs(realized_vol_1h) - {b.vol_low}) / ({b.vol_high} - {b.vol_low})", 0.0, 1.0)
    raw = d.half_even(f"{b.longest} - ({share}) * ({b.longest} - {b.shortest})")
    return f"CASE WHEN realized_vol_1h IS NULL THEN {b.base} ELSE CAST({clip(raw, b.shortest, b.longest)} AS INTEGER) END"


def exit_price(direction: int, b: Barriers) -> str:
    """The exit on bar x, the stop before the take; a gap beyond the stop fills at the open. NULL if neither is touched."""
    if direction == 1:
        return f"CASE WHEN x.low <= stop_long THEN (CASE WHEN x.open < stop_long THEN x.open ELSE stop_long END) * (1 - {b.slippage}) WHEN x.high >= take_long THEN take_long * (1 - {b.slippage}) END"
    return f"CASE WHEN x.high >= stop_short THEN (CASE WHEN x.open > stop_short THEN x.open ELSE stop_short END) * (1 + {b.slippage}) WHEN x.low <= take_short THEN take_short * (1 + {b.slippage}) END"


def label_levels(b: Barriers, d: Dialect) -> list[dict[str, str]]:
    """Levels on (symbol, ts, prices, realized_vol_1h)."""
    stop = "CASE WHEN atr_part IS NULL THEN vol_part WHEN vol_part IS NULL THEN atr_part ELSE greatest(atr_part, vol_part) END"
    return [
        {"lab_c": lag("close"), "horizon": horizon(b, d)},
        {"lab_tr": true_range().replace("lc", "lab_c"), "next_open": "lead(open, 1) OVER (PARTITION BY symbol ORDER BY ts)", "max_horizon": "max(horizon) OVER (PARTITION BY symbol)", "rows_left": "count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"},
        {"lab_atr": full("avg", "lab_tr", 14)},
        {"atr_part": f"abs(lab_atr / nullif(close, 0)) * {b.atr_multiple}", "vol_part": f"abs(realized_vol_1h) * sqrt(greatest(horizon, 1)) * {b.vol_multiple}"},
        {"barrier_stop_pct": clip(stop, b.least, b.most) if b.dynamic else str(b.fixed_stop)},
        {"barrier_take_pct": f"barrier_stop_pct * {b.take_to_stop}" if b.dynamic else str(b.fixed_take), "entry_long": f"next_open * (1 + {b.slippage})", "entry_short": f"next_open * (1 - {b.slippage})"},
        {"stop_long": "entry_long * (1 - barrier_stop_pct)", "take_long": "entry_long * (1 + barrier_take_pct)", "stop_short": "entry_short * (1 + barrier_stop_pct)", "take_short": "entry_short * (1 - barrier_take_pct)", "ahead": d.following(["open", "high", "low"], max(b.longest, b.base))},
        {"exit_long": d.first_found("ahead", "horizon", exit_price(1, b)), "exit_short": d.first_found("ahead", "horizon", exit_price(-1, b))},
        {
            "long_pnl": f"CASE WHEN exit_long IS NULL THEN 0.0 ELSE (exit_long - entry_long) / nullif(entry_long, 0) - 2 * {b.taker} END",
            "short_pnl": f"CASE WHEN exit_short IS NULL THEN 0.0 ELSE (entry_short - exit_short) / nullif(entry_short, 0) - 2 * {b.taker} END",
        },
        {"Target": "CASE WHEN rows_left < max_horizon THEN 0 WHEN long_pnl > 0 AND short_pnl <= 0 THEN 1 WHEN short_pnl > 0 AND long_pnl <= 0 THEN -1 ELSE 0 END"},
    ]


def label(frame: DataFrame, b: Barriers = Barriers()) -> DataFrame:
    """frame with horizon, barrier_stop_pct, barrier_take_pct, long_pnl, short_pnl and Target. The last max_horizon rows of a symbol have 0."""
    if "realized_vol_1h" not in frame.columns and b.dynamic:
        raise ValueError("dynamic barriers need realized_vol_1h")
    out = levels(frame, label_levels(b, SPARK))
    return out.select(*frame.columns, "horizon", "barrier_stop_pct", "barrier_take_pct", "long_pnl", "short_pnl", "Target")


def finalise(frame: DataFrame, columns: list[str], b: Barriers = Barriers()) -> DataFrame:
    """Drops the last look_ahead rows of each symbol, and rows with a NULL, NaN or infinity in any of columns.

    Each column is a predicate of its own: one expression over all of them costs the optimiser time that doubles with each column.
    """
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    left = F.count("*").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, Window.unboundedFollowing))
    kinds, out = dict(frame.dtypes), frame.withColumn("__left", left).where(F.col("__left") >= b.look_ahead).drop("__left")
    for c in columns:
        out = out.where(F.abs(c) < float("inf") if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return out


def null_profile(frame: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """(column, missing) of the columns that miss most values, a report of ``most`` rows."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*")
    return rows.where("missing > 0").orderBy(F.desc("missing"), "column").limit(most)
