"""Trade journal: an append-only log of states, the latest state of each trade, and its aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import SCHEMAS, Store

FIELDS = [x.split(" ") for x in SCHEMAS["execution_trades"].split(", ")]


@dataclass
class Journal:
    """The journal in a store. Opening, changing and closing trades append states; nothing is rewritten. Writers must take turns."""

    store: Store

    def log(self) -> DataFrame:
        return self.store.read("execution_trades")

    def trades(self, status: str | None = None, symbol: str | None = None) -> DataFrame:
        """The latest state of each trade, of one status or symbol where given."""
        rows = latest(self.log() if symbol is None else self.log().where(F.col("symbol") == symbol))
        return rows if status is None else rows.where(F.col("status") == status)

    def append(self, states: DataFrame) -> None:
        """States with any of the journal's columns; the others are NULL."""
        known = set(states.columns)
        if unknown := known - {n for n, _ in FIELDS}:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        rows = states.select(*[(F.col(n) if n in known else F.lit(None)).cast(t).alias(n) for n, t in FIELDS])
        rows.write.mode("append").parquet(self.store.path("execution_trades"))

    def open(self, trades: DataFrame, now_ms: int) -> None:
        """Opens trades. Ids that the journal already has raise."""
        if not trades.select("id").intersect(self.log().select("id")).isEmpty() or trades.count() != trades.select("id").distinct().count():
            raise ValueError("a trade with this id was opened before")
        self.append(trades.withColumns({"status": F.lit("open"), "created_at_ms": F.lit(now_ms), "updated_at_ms": F.lit(now_ms)}))

    def change(self, changes: DataFrame, now_ms: int) -> int:
        """A new state for each open trade in changes (id and the columns to set). How many there are; ids that aren't open count for nothing."""
        sets = [c for c in changes.columns if c != "id"]
        renamed = changes.select("id", *[F.col(c).alias(f"__{c}") for c in sets])
        rows = self.trades("open").join(renamed, "id")
        kept = [c for c, _ in FIELDS if c not in (*sets, "updated_at_ms")]
        rows = rows.select(*kept, *[F.col(f"__{c}").alias(c) for c in sets], F.greatest(F.col("updated_at_ms") + 1, F.lit(now_ms)).alias("updated_at_ms"))
        n = rows.count()  # the rows' files are listed already, so those written next don't count
        self.append(rows)
        return n

    def close(self, exits: DataFrame, now_ms: int) -> int:
        """Closes open trades: exits has id, exit_ts_ms, exit_price, exit_reason and, if known, pnl_pct, pnl_quote and fees_quote."""
        return self.change(exits.withColumn("status", F.lit("closed")), now_ms)

    def set_state(self, key: str, value: str | None) -> None:
        """Engine state under a key."""
        self.store.upsert("execution_engine_state", self.store.spark.createDataFrame([(key, value)], SCHEMAS["execution_engine_state"]))

    def state(self, key: str) -> str | None:
        row = self.store.read("execution_engine_state").where(F.col("k") == key).first()
        return row and row["v"]


def journal(store: Store, backend: str = "parquet") -> Journal:
    """The journal of a named back end; Parquet tables are the only one here."""
    if backend.strip().lower() != "parquet":
        raise ValueError(f"unknown back end: {backend}")
    return Journal(store)


def latest(log: DataFrame) -> DataFrame:
    """The last state of each trade id."""
    others = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*others), F.struct("updated_at_ms", "status")).alias("x")).select("id", "x.*").select(log.columns)


def summary(trades: DataFrame, now_ms: int, leverage: float) -> DataFrame:
    """One row: open trades, stops since midnight, last stop, closed pnl, and margin of open trades (0 if leverage is not above 0)."""
    midnight = now_ms - now_ms % 86_400_000
    is_open, stopped = F.col("status") == "open", (F.col("status") == "closed") & (F.col("exit_reason") == "SL")
    margin = F.coalesce(F.sum(F.when(is_open, F.col("entry_notional"))), F.lit(0.0)) / leverage if leverage > 0 else F.lit(0.0)
    return trades.agg(F.count_if(is_open).alias("open_trades"), F.count_if(stopped & (F.col("exit_ts_ms") >= midnight)).alias("stops_today"), F.max(F.when(stopped, F.col("exit_ts_ms"))).alias("last_stop_ms"), F.coalesce(F.sum(F.when(F.col("status") == "closed", F.col("pnl_quote"))), F.lit(0.0)).alias("closed_pnl"), margin.alias("open_margin"))
