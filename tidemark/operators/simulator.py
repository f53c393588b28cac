"""Portfolio simulation: an ordered fold over the bars of a run; runs (folds, parameters) are simulated in parallel.

Balance, margin, loss streak and cool-downs depend on every trade before, so a run is one ordered pass; its input is a row a bar and symbol.
Decisions of a bar use what stood before its exits.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    balance: float = 100.0
    leverage: float = 1.0
    risk: float = 0.01
    reduced_risk: float = 0.005
    reduce_after: int = 2
    threshold: float = 0.55
    least_gap: float = 0.01
    new_per_bar: int = 1
    most_open: int = 1
    cooldown: int = 8
    stops_per_day: int = 3
    taker: float = 0.0004
    slippage: float = 0.0003
    least_notional: float = 10.0
    longs: bool = True
    shorts: bool = True


OUT = "run_id string, kind string, i long, ts long, trade_number long, symbol string, direction string, reason string, pnl_pct double, pnl_abs double, commission double, equity double"
DAY_MS = 86_400_000


def steps(candles: DataFrame, signals: DataFrame, step_ms: int) -> DataFrame:
    """A row for each symbol that has a bar at time t and at the next time of the whole timeline, with the signal decided at t's close.

    candles: (run_id, symbol, open_time, open, high, low, close); signals: (run_id, symbol, ts, p_long, p_short, barrier_stop_pct, barrier_take_pct).
    """
    line = candles.select("run_id", "open_time").distinct()
    line = line.withColumn("next_time", F.lead("open_time").over(Window.partitionBy("run_id").orderBy("open_time"))).withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("open_time")) - 1)
    now = candles.select("run_id", "symbol", "open_time", F.col("close").alias("current_close")).join(line, ["run_id", "open_time"])
    then = candles.select("run_id", "symbol", F.col("open_time").alias("next_time"), F.col("open").alias("next_open"), F.col("high").alias("next_high"), F.col("low").alias("next_low"))
    rows = now.join(then, ["run_id", "symbol", "next_time"], "left")
    decided = signals.select("run_id", "symbol", (F.col("ts") - step_ms).alias("open_time"), "p_long", "p_short", "barrier_stop_pct", "barrier_take_pct")
    return rows.join(decided, ["run_id", "symbol", "open_time"], "left")


def exit_of(direction: int, entry: float, row, stop: float, take: float, rules: Rules) -> tuple[float, str] | None:
    """Exit price and reason on the next bar. Long and short are mirror images."""
    s = direction
    stop_at, take_at = entry * (1 - s * stop), entry * (1 + s * take)
    worst, best = (row.next_low, row.next_high) if s == 1 else (row.next_high, row.next_low)
    if s * worst <= s * stop_at:
        return (row.next_open if s * row.next_open < s * stop_at else stop_at) * (1 - s * rules.slippage), "SL"
    if s * best >= s * take_at:
        return take_at * (1 - s * rules.slippage), "TP"
    return None


class Book:
    """The state of a run."""

    def __init__(self, run_id: str, rules: Rules):
        self.run_id, self.rules = run_id, rules
        self.balance, self.margin, self.losses, self.day_stops, self.day = rules.balance, 0.0, 0, 0, None
        self.open: dict[str, dict] = {}
        self.wait: dict[str, int] = {}
        self.number, self.out = 1, []

    def pnl(self, p: dict, price: float) -> float:
        return p["dir"] * (price - p["entry"]) / p["entry"] - 2 * self.rules.taker

    def equity(self, marks: dict[str, float]) -> float:
        return self.balance + sum(p["size"] * self.pnl(p, marks[s]) for s, p in self.open.items() if s in marks)

    def mark(self, i: int, ts: int, marks: dict[str, float]) -> None:
        self.out.append((self.run_id, "equity", i, ts, None, None, None, None, None, None, None, self.equity(marks)))

    def close(self, i: int, ts: int, symbol: str, price: float, reason: str) -> None:
        p = self.open.pop(symbol)
        share = self.pnl(p, price)
        self.margin = max(0.0, self.margin - p["margin"])
        self.balance += p["size"] * share
        self.out.append((self.run_id, "trade", i, ts, p["number"], symbol, "LONG" if p["dir"] == 1 else "SHORT", reason, share, p["size"] * share, p["size"] * 2 * self.rules.taker, None))
        if reason == "FINAL":
            return
        self.losses = 0 if share > 0 else self.losses + 1
        if reason == "SL":
            self.day_stops += 1
            if self.rules.cooldown > 0:
                self.wait[symbol] = i + self.rules.cooldown


def candidates(rows: list, book: Book, i: int, balance: float, risk: float, taken: set[str], wait: dict[str, int]) -> list[dict]:
    rules, out = book.rules, []
    for row in rows:
        if row.symbol in taken or i < wait.get(row.symbol, -1) or not row.p_long == row.p_long:
            continue
        stop, take = row.barrier_stop_pct, row.barrier_take_pct
        if not (0 < stop < float("inf") and 0 < take < float("inf")):
            continue
        gap = abs(row.p_long - row.p_short)
        if row.p_long >= rules.threshold and row.p_long - row.p_short >= rules.least_gap:
            side, p = 1, row.p_long
        elif row.p_short >= rules.threshold and row.p_short - row.p_long >= rules.least_gap:
            side, p = -1, row.p_short
        else:
            continue
        if not (rules.longs if side == 1 else rules.shorts):
            continue
        size = min(balance * risk / stop, balance * rules.leverage)
        if size >= rules.least_notional:
            out.append({"row": row, "dir": side, "p": p, "score": max(0.0, p - rules.threshold) * 10 + gap, "size": size, "margin": size / rules.leverage, "entry": row.next_open * (1 + side * rules.slippage), "stop": stop, "take": take})
    return sorted(out, key=lambda c: (c["score"], c["p"]), reverse=True)  # stable: equal candidates keep their symbols' order


def run_book(bars: pd.DataFrame, run_id: str, rules: Rules) -> list[tuple]:
    """Trades and equity marks of one run."""
    book = Book(run_id, rules)
    last_i = int(bars["i"].max())
    for i, bar in bars.sort_values(["i", "symbol"], kind="stable").groupby("i", sort=True):
        i, everything = int(i), list(bar.itertuples(index=False))
        ts = int(everything[0].open_time)
        if i == last_i:
            marks = {r.symbol: r.current_close for r in everything}
            for symbol in [s for s in sorted(book.open) if s in marks]:
                side = book.open[symbol]["dir"]
                book.close(i, ts, symbol, marks[symbol] * (1 - side * rules.slippage), "FINAL")
            book.mark(i, ts, marks)
            break
        then = int(everything[0].next_time)
        if book.day != then // DAY_MS:
            book.day, book.day_stops = then // DAY_MS, 0
        rows = [r for r in everything if r.next_open == r.next_open]
        book.mark(i, ts, {r.symbol: r.current_close for r in rows})
        before = (book.balance, book.margin, book.losses, book.day_stops, set(book.open), dict(book.wait))
        for row in rows:
            if (p := book.open.get(row.symbol)) and (end := exit_of(p["dir"], p["entry"], row, p["stop"], p["take"], rules)):
                book.close(i, then, row.symbol, *end)
        balance, margin, losses, stops, taken, wait = before
        reduced = rules.reduce_after > 0 and 0 < rules.reduced_risk < rules.risk and losses >= rules.reduce_after
        if rules.stops_per_day > 0 and stops >= rules.stops_per_day:
            continue
        free, opened, held = max(0.0, balance - margin), 0, len(taken)
        for c in candidates(rows, book, i, balance, rules.reduced_risk if reduced else rules.risk, taken, wait):
            if opened >= rules.new_per_bar or held >= rules.most_open or free <= 0:
                break
            need = min(c["margin"], free)
            size = min(c["size"], need * rules.leverage)
            if size < rules.least_notional or need <= 0:
                continue
            free -= need
            book.margin += need
            symbol = c["row"].symbol
            book.open[symbol] = {"number": book.number, "dir": c["dir"], "entry": c["entry"], "size": size, "margin": need, "stop": c["stop"], "take": c["take"]}
            book.number, opened, held = book.number + 1, opened + 1, held + 1
            if end := exit_of(c["dir"], c["entry"], c["row"], c["stop"], c["take"], rules):
                book.close(i, then, symbol, *end)
    return book.out


def overlapping(candles: DataFrame, start: int, end: int, least: int = 2) -> DataFrame:
    """The candles of the symbols that have at least ``least`` of them from start to end (open_time, both included)."""
    inside = candles.where(F.col("open_time").between(start, end)).groupBy("symbol").agg(F.count("*").alias("n"))
    return candles.join(inside.where(F.col("n") >= least).select("symbol"), "symbol", "left_semi")


def simulate(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades and equity marks (kind) of every run_id in steps()."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(run_book(part, part["run_id"].iloc[0], rules), columns=names)

    return rows.groupBy("run_id").applyInPandas(run, OUT)
