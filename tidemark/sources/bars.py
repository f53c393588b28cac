"""Bars and the series beside them, aggregated from an event stream.

The event table is the large input. Each aggregate below combines on the map side and shuffles one row a bar and task, so it
scales with the input's size; what follows works on bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def keyed(events: DataFrame, step_ms: int) -> DataFrame:
    ms = epoch_ms(F.col("ts").cast("timestamp_ntz"))
    return events.select(F.col("event_type").alias("symbol"), (F.floor(ms / step_ms) * step_ms).cast("long").alias("open_time"), "ts", "event_id", "value")


def ends() -> tuple[Column, Column]:
    """Orders of events for a bar's first and last value: by time, and of events at one time the one of the smallest id counts at either end.

    The SQL leaves that open; its engine keeps the first row of the table. Events without a value count at neither end.
    """
    there = F.col("value").isNotNull()
    return F.when(there, F.struct("ts", "event_id")), F.when(there, F.struct("ts", -F.col("event_id")))


def candles(events: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """(symbol, open_time, ts, open, high, low, close, volume, quote_volume); ts is the close, the time of decision."""
    first, last = ends()
    return keyed(events, step_ms).groupBy("symbol", "open_time").agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", last).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("quote_volume")
    ).select("symbol", "open_time", (F.col("open_time") + step_ms).alias("ts"), "open", "high", "low", "close", "volume", "quote_volume")


def funding_rates(events: DataFrame, step_ms: int = 8 * HOUR_MS) -> DataFrame:
    """(symbol, ts, funding_rate), stamped at the end of each interval."""
    return keyed(events, step_ms).groupBy("symbol", "open_time").agg(F.avg("value").alias("funding_rate")).select("symbol", (F.col("open_time") + step_ms).alias("ts"), "funding_rate")


def premium_index(events: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """(symbol, ts, premium_index_close): mean less median of each interval, at its close."""
    return keyed(events, step_ms).groupBy("symbol", "open_time").agg((F.avg("value") - F.percentile("value", F.lit(0.5))).alias("premium_index_close")).select("symbol", (F.col("open_time") + step_ms).alias("ts"), "premium_index_close")


def open_interest(events: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """(symbol, ts, open_interest): the running count of events at each interval's end."""
    counts = keyed(events, step_ms).groupBy("symbol", "open_time").agg(F.count("*").cast("double").alias("n"))
    running = F.sum("n").over(Window.partitionBy("symbol").orderBy("open_time"))
    return counts.select("symbol", (F.col("open_time") + step_ms).alias("ts"), running.alias("open_interest"))


def duckdb(step_ms: int = HOUR_MS) -> str:
    """candles() in DuckDB's SQL."""
    return f"""SELECT event_type AS symbol, CAST(epoch_ms(ts) // {step_ms} * {step_ms} AS BIGINT) AS open_time, CAST(epoch_ms(ts) // {step_ms} * {step_ms} + {step_ms} AS BIGINT) AS ts,
        arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume
        FROM events GROUP BY ALL"""


def duckdb_series(what: str) -> str:
    """The other series in DuckDB's SQL, by name."""
    step = 8 * HOUR_MS if what == "funding_rate" else HOUR_MS
    value = {"funding_rate": "avg(value)", "premium_index_close": "avg(value) - quantile_cont(value, 0.5)"}.get(what)
    if what == "open_interest":
        return f"SELECT symbol, ts, sum(n) OVER (PARTITION BY symbol ORDER BY ts) AS open_interest FROM (SELECT event_type AS symbol, CAST(epoch_ms(ts) // {step} * {step} + {step} AS BIGINT) AS ts, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)"
    return f"SELECT event_type AS symbol, CAST(epoch_ms(ts) // {step} * {step} + {step} AS BIGINT) AS ts, {value} AS {what} FROM events GROUP BY ALL"
