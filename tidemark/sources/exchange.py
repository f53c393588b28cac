"""Exchange payloads: request windows, mappers, and a batch source that reads stored answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PLACES = {"a": 6, "b": 7}  # where an answer has the quote volume


def request_windows(spark: SparkSession, start: int, end: int, step_ms: int, most: int = 1000, listed: int | None = None) -> DataFrame:
    """(k, start, end): windows of at most ``most`` bars, both ends included; nothing is asked for before the symbol was ``listed``."""
    start = start if listed is None else max(start, listed)
    span = step_ms * max(most - 1, 1)
    if start > end:
        return spark.createDataFrame([], "k int, start bigint, end bigint")
    row = spark.range(1).select(F.posexplode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(span + step_ms).cast("long"))).alias("k", "start"))
    return row.select("k", "start", F.least(F.col("start") + span, F.lit(end)).alias("end"))


def klines(payloads: DataFrame, provider: str, price_only: bool = False) -> DataFrame:
    """(symbol, open_time, open, high, low, close, volume, quote_volume) of payloads (symbol, payload JSON). Short rows of price series are left out, and rows without a readable time; other numbers that cannot be read are null."""
    text = F.get_json_object("payload", "$.result.list") if provider == "a" else F.col("payload")
    rows = payloads.select("symbol", F.explode(F.from_json(text, "array<array<string>>")).alias("x"))
    if price_only:
        rows = rows.where(F.size("x") >= 5)
    at = lambda i, kind="double": F.try_element_at("x", F.lit(i + 1)).try_cast(kind)
    volume = [F.lit(0.0), F.lit(0.0)] if price_only else [at(5), at(PLACES[provider])]
    rows = rows.where(at(0, "bigint").isNotNull())
    return rows.select("symbol", at(0, "bigint").alias("open_time"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), volume[0].alias("volume"), volume[1].alias("quote_volume"))


def points(payloads: DataFrame, provider: str, what: str) -> DataFrame:
    """Funding rates (symbol, funding_time, funding_rate) or open interest (symbol, timestamp, open_interest); rows without time or value are left out."""
    text = F.get_json_object("payload", "$.result.list") if provider == "a" else F.col("payload")
    if what == "open_interest":
        if provider == "b":
            raise NotImplementedError("this provider has no open interest")
        names = ("timestamp", "openInterest", "timestamp", "open_interest")
    else:
        names = ("fundingRateTimestamp" if provider == "a" else "fundingTime", "fundingRate", "funding_time", "funding_rate")
    rows = payloads.select("symbol", F.explode(F.from_json(text, "array<map<string,string>>")).alias("x"))
    out = rows.select("symbol", F.try_element_at("x", F.lit(names[0])).try_cast("bigint").alias(names[2]), F.try_element_at("x", F.lit(names[1])).try_cast("double").alias(names[3]))
    return out.where(F.col(names[2]).isNotNull() & F.col(names[3]).isNotNull())


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """After fetches that end in any order: of equal keys the one fetched last."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def with_retry(call: Callable[[], dict], attempts: int = 5, sleep: float = 0.5, wait: Callable[[float], None] = time.sleep) -> dict:
    """Calls until it works, waiting sleep * 2 ** attempt between; the last error is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except (OSError, ValueError, RuntimeError):
            if attempt == attempts - 1:
                raise
            wait(sleep * 2**attempt)
    raise ValueError("no attempt was allowed")


@dataclass
class RateLimit:
    """Request weights per minute; an answer 418 or 429 closes the gate for as long as it says."""

    per_minute: int = 2400
    clock: Callable[[], float] = time.monotonic
    used: float = 0.0
    since: float = 0.0
    closed_until: float = 0.0

    def wait_for(self, weight: int) -> float:
        """Seconds to wait before a request of this weight, which counts as sent then."""
        now = self.clock()
        pause = max(0.0, self.closed_until - now)
        if now + pause - self.since >= 60:
            self.since, self.used = now + pause, 0.0
        if self.used + weight > self.per_minute:
            pause = max(pause, self.since + 60 - now)
            self.since, self.used = now + pause, 0.0
        self.used += weight
        return pause

    def told(self, status: int, headers: dict[str, str], default: float = 60.0) -> None:
        if status in (418, 429):
            found = {k.lower(): v for k, v in headers.items()}
            text = found.get("retry-after") or found.get("x-mbx-retry-after")
            self.closed_until = self.clock() + (float(text) if text and text.replace(".", "", 1).isdigit() else default)


class Window(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        start, end, step, most = (int(self.options[k]) for k in ("start", "end", "step_ms", "most"))
        span = step * max(most - 1, 1)
        return [Window(a, min(a + span, end)) for a in range(start, end + 1, span + step)]

    def read(self, window: Window) -> Iterator[tuple]:
        """A task a request window. Answers come from stored JSON lines {symbol, payload rows}; a network client would stand here."""
        symbol = self.options["symbol"]
        with open(self.options["answers"]) as lines:
            for line in lines:
                answer = json.loads(line)
                if answer["symbol"] == symbol:
                    for x in answer["list"]:
                        if window.start <= int(x[0]) <= window.end:
                            yield (symbol, int(x[0]), *(float(v) for v in x[1:7]))


class BarSource(DataSource):
    """spark.read.format("exchange_bars"): options answers, symbol, start, end, step_ms, most."""

    @classmethod
    def name(cls) -> str:
        return "exchange_bars"

    def schema(self) -> str:
        return "symbol string, open_time bigint, open double, high double, low double, close double, volume double, quote_volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
