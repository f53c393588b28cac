"""Live bars with Structured Streaming: closed-bar frames, event-time bars, running averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import ends

_ROW = "start bigint, end bigint, open string, high string, low string, close string, volume string, confirm boolean, timestamp bigint"
FRAME = f"op string, topic string, ts bigint, data array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>"


def closed_bars(frames: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """Closed bars of JSON frames (value). Control frames, other topics, bad JSON, bars that are not confirmed and bars with a price that cannot be read are left out."""
    x = frames.select(F.from_json("value", FRAME, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where(F.col("op").isNull() & F.col("topic").startswith("kline."))
    if topics is not None:
        x = x.where(F.col("topic").isin(topics))
    rows = x.select("topic", "ts", F.explode("data").alias("r")).where("r.confirm")
    part = F.split("topic", r"\.")
    price = lambda c: F.col(f"r.{c}").try_cast("double")
    for c in ("open", "high", "low", "close"):
        rows = rows.where(price(c).isNotNull())
    return rows.where(F.size(part) >= 3).select("topic", part[2].alias("symbol"), part[1].alias("interval"), F.col("r.start").alias("start_ms"), F.col("r.end").alias("end_ms"), price("open").alias("open_price"), price("high").alias("high_price"), price("low").alias("low_price"), price("close").alias("close_price"), F.coalesce(price("volume"), F.lit(0.0)).alias("volume"), F.coalesce("ts", "r.timestamp", "r.end").alias("source_ts_ms"))


def tumbling_bars(events: DataFrame, width: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Bars of a stream (or table) of (ts, event_type, value, event_id); a bar comes out when the watermark has passed it."""
    first, last = ends()
    if dict(events.dtypes)["ts"] == "timestamp_ntz":  # read as UTC, whatever the session's time zone
        events = events.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", last).alias("close"), F.count("*").alias("volume")).select(F.col("event_type").alias("symbol"), F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume")


def once_each(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars that a reconnect sent twice, once."""
    return bars.withColumn("at", F.timestamp_millis("start_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["topic", "start_ms"])


def running_ema(bars: DataFrame, span: int) -> DataFrame:
    """(symbol, start_ms, ema) of a stream of closed bars; the state of a symbol is one number and its last time. Bars that come out of order are left out."""
    alpha = 2.0 / (span + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("start_ms", kind="stable")
        out = []
        for t, close in zip(rows["start_ms"].tolist(), rows["close_price"].tolist(), strict=True):
            if last is not None and t <= last:
                continue
            value, last = close if value is None else (1 - alpha) * value + alpha * close, t
            out.append((key[0], t, value))
        if last is not None:
            state.update((value, last))
        yield pd.DataFrame(out, columns=["symbol", "start_ms", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, start_ms long, ema double", "value double, last long", "append", GroupStateTimeout.NoTimeout)
