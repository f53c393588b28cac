"""The feature pipeline: base bars, series beside them and higher-timeframe bars to one wide frame.

Exchanges: one by symbol for all per-symbol levels (the recursion keeps it), one by time for the cross-sections, one by symbol for
the as-of join and the interactions. The request is followed down the levels: columns, joins, recursions and tables that nothing
requested needs are not in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.dialect import DUCKDB, SPARK, doubles
from ..functions.registry import Registry
from ..sources import bars
from .asof import asof
from .recursive import HTF_NAMES, MAIN_NAMES, duckdb, htf_averages, main_averages, with_averages

PRICES = ["open", "high", "low", "close", "volume"]


def levels(df: DataFrame, which: list[dict[str, str]]) -> DataFrame:
    for level in which:
        df = df.withColumns({name: F.expr(doubles(sql)) for name, sql in level.items()})
    return df


def needed(which: list[dict[str, str]], wanted: set[str]) -> tuple[list[dict[str, str]], set[str]]:
    """The levels without the columns that ``wanted`` does not rest on, and the columns that they and ``wanted`` need of the rows below them."""
    out = []
    for level in reversed(which):
        own = {name: sql for name, sql in level.items() if name in wanted}
        wanted = (wanted - set(own)) | {word for sql in own.values() for word in re.findall(r"[A-Za-z_]\w*", sql)}
        if own:
            out.insert(0, own)
    return out, wanted


def averaged(before: list[dict[str, str]], after: list[dict[str, str]], make, names: list[str], inputs: set[str], wanted: set[str]):
    """(a function that adds the levels and the recursion between them, as far as needed, what they need of the rows)."""
    late, under = needed(after, wanted)
    recursive = bool(under & set(names))
    early, base = needed(before, under | inputs if recursive else under)

    def add(rows: DataFrame) -> DataFrame:
        rows = levels(rows, early)
        return levels(with_averages(rows, make, names) if recursive else rows, late)

    return add, base


HTF_INPUTS, MAIN_INPUTS = {"close", "tr", "plus_dm", "minus_dm"}, {"close", "dc", "realized_vol_1h"}


def higher_timeframe(htf: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(symbol, ts, wanted features) of the higher timeframe, all without ``wanted``; every output is lagged by one bar of it."""
    wanted = [*fx.BLOCKS["htf"], *fx.HTF_CROSS] if wanted is None else wanted
    add, _ = averaged(fx.htf_before(SPARK), fx.htf_after(SPARK), htf_averages, HTF_NAMES, HTF_INPUTS, set(wanted))
    return add(htf).select("symbol", "ts", *wanted)


def build(main: DataFrame, htf: DataFrame, funding: DataFrame, premium: DataFrame, interest: DataFrame, benchmark: str, request: fx.Request | Iterable[str] = fx.Request()) -> DataFrame:
    """(symbol, ts, prices, requested features in order of name). All frames are keyed by (symbol, ts), ts being the time of decision."""
    names = fx.resolve(request)
    last, wanted = needed(fx.interactions(SPARK), set(names))
    wide = [c for c in (*fx.BLOCKS["htf"], *fx.HTF_CROSS) if c in wanted]
    add, base = averaged(fx.main_before(SPARK), fx.main_after(SPARK, benchmark), main_averages, MAIN_NAMES, MAIN_INPUTS, wanted - set(wide))
    rows = main.select("symbol", "ts", *PRICES)
    for right, column in ((funding, "funding_rate"), (premium, "premium_index_close"), (interest, "open_interest")):
        if column in base:
            rows = asof(rows, right, "symbol", "ts", [column])
    if "benchmark_close" in base:
        rows = rows.join(main.where(F.col("symbol") == benchmark).select("ts", F.col("close").alias("benchmark_close")), "ts", "left")
    rows = add(rows)
    if wide:
        rows = asof(rows, higher_timeframe(htf, wide), "symbol", "ts", wide)
    return levels(rows, last).select("symbol", "ts", *PRICES, *names)


def build_with(registry: Registry, names: Iterable[str], settings: Mapping[str, float], frames: list[DataFrame], benchmark: str) -> DataFrame:
    """(symbol, ts, prices, names in order): catalogue features and registered ones side by side. frames: what ``build`` takes, in its order.

    Registered features are levels above the catalogue's; only the catalogue features that these or the request name are planned.
    """
    names = sorted(set(names))
    own, wanted = registry.plan(names, settings)
    return levels(build(*frames, benchmark, wanted), own).select("symbol", "ts", *PRICES, *names)


def from_events(events: DataFrame, benchmark: str, request: fx.Request | Iterable[str] = fx.Request()) -> DataFrame:
    return build(*frames_of(events), benchmark, request)


def frames_of(events: DataFrame) -> list[DataFrame]:
    """Base bars, higher-timeframe bars, funding rates, premium index and open interest."""
    return [bars.candles(events), bars.candles(events, 4 * bars.HOUR_MS), bars.funding_rates(events), bars.premium_index(events), bars.open_interest(events)]


def duckdb_levels(first: str, which: list[dict[str, str]], prefix: str) -> tuple[list[str], str]:
    """Table expressions for levels over the table ``first``; the name of the last."""
    parts, at = [], first
    for k, level in enumerate(which):
        columns = ", ".join(f"{doubles(sql)} AS {name}" for name, sql in level.items())
        parts.append(f"{prefix}{k} AS (SELECT *, {columns} FROM {at})")
        at = f"{prefix}{k}"
    return parts, at


def duckdb_frame(benchmark: str) -> tuple[list[str], str]:
    """Table expressions (for WITH RECURSIVE) of the whole frame, and the name of the last."""
    parts = [f"c1 AS ({bars.duckdb()})", f"c4 AS ({bars.duckdb(4 * bars.HOUR_MS)})"]
    parts += [f"s_{x} AS ({bars.duckdb_series(x)})" for x in ("funding_rate", "premium_index_close", "open_interest")]
    parts.append(f"""base AS (SELECT c1.symbol, c1.ts, c1.open, c1.high, c1.low, c1.close, c1.volume, f.funding_rate, p.premium_index_close, o.open_interest, b.close AS benchmark_close FROM c1
        ASOF LEFT JOIN s_funding_rate f ON f.symbol = c1.symbol AND f.ts <= c1.ts ASOF LEFT JOIN s_premium_index_close p ON p.symbol = c1.symbol AND p.ts <= c1.ts
        ASOF LEFT JOIN s_open_interest o ON o.symbol = c1.symbol AND o.ts <= c1.ts LEFT JOIN (SELECT ts, close FROM c1 WHERE symbol = '{benchmark}') b ON b.ts = c1.ts)""")
    more, at = duckdb_levels("base", fx.main_before(DUCKDB), "mb")
    parts += more
    parts.append(f"m_in AS (SELECT *, CASE WHEN dc IS NULL THEN NULL ELSE greatest(dc, 0.0) END AS gain, CASE WHEN dc IS NULL THEN NULL ELSE greatest(-dc, 0.0) END AS loss FROM {at})")
    parts.append(duckdb("m_in", {"ema12": ("close", 2 / 13), "ema48": ("close", 2 / 49), "g": ("gain", 1 / 14), "l": ("loss", 1 / 14), "rvol_ema48": ("realized_vol_1h", 2 / 49)}, "m_rec"))
    parts.append("m_all AS (SELECT m_in.*, r.ema12, r.ema48, r.rvol_ema48, CASE WHEN m_in.rn >= 15 THEN r.g END AS avg_gain, CASE WHEN m_in.rn >= 15 THEN r.l END AS avg_loss FROM m_in JOIN m_rec r USING (symbol, rn))")
    more, main = duckdb_levels("m_all", fx.main_after(DUCKDB, benchmark), "ma")
    parts += more
    more, at = duckdb_levels("c4", fx.htf_before(DUCKDB), "hb")
    parts += more
    parts.append(duckdb(at, {"ema21": ("close", 2 / 22), "a": ("tr", 1 / 14), "p": ("plus_dm", 1 / 14), "m": ("minus_dm", 1 / 14)}, "h_rec"))
    parts.append("h_dx AS (SELECT symbol, rn, ema21, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM (SELECT *, 100 * p / nullif(a, 0) AS pdi, 100 * m / nullif(a, 0) AS mdi FROM h_rec))")
    parts.append(duckdb("h_dx", {"adx": ("dx", 1 / 14)}, "h_adx"))
    parts.append(f"h_all AS (SELECT {at}.*, h_dx.ema21, h_adx.adx FROM {at} JOIN h_dx USING (symbol, rn) JOIN h_adx USING (symbol, rn))")
    more, htf = duckdb_levels("h_all", fx.htf_after(DUCKDB), "ha")
    parts += more
    wide = ", ".join(f"h.{n}" for n in (*fx.BLOCKS["htf"], *fx.HTF_CROSS))
    parts.append(f"joined AS (SELECT m.*, {wide} FROM {main} m ASOF LEFT JOIN {htf} h ON h.symbol = m.symbol AND h.ts <= m.ts)")
    more, last = duckdb_levels("joined", fx.interactions(DUCKDB), "x")
    return parts + more, last
