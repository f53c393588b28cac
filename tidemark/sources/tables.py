"""Stored tables: schemas, range scans, insert-or-ignore, replace, sync state and incremental sync."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

_PRICES = "open double, high double, low double, close double"
SCHEMAS: dict[str, str] = {
    "candles": f"symbol string, timeframe string, open_time bigint, {_PRICES}, volume double, quote_volume double",
    "funding_rates": "symbol string, funding_time bigint, funding_rate double",
    "premium_index_klines": f"symbol string, timeframe string, open_time bigint, {_PRICES}",
    "open_interest": "symbol string, timeframe string, timestamp bigint, open_interest double",
    "data_sync_state": "dataset string, symbol string, timeframe string, empty_since_ts bigint, last_checked_ts bigint",
    "execution_trades": "id bigint, execution_type string, status string, exchange_code string, symbol string, direction int, timeframe_signal string, signal_bar_open_ms bigint, entry_bar_open_ms bigint, entry_ts_ms bigint, entry_price double, entry_notional double, stop_pct double, take_pct double, p_long double, p_short double, signal_gap double, model_name string, last_1m_scan_open_ms bigint, exit_ts_ms bigint, exit_price double, exit_reason string, pnl_pct double, pnl_quote double, fees_quote double, meta_json string, created_at_ms bigint, updated_at_ms bigint",
    "execution_engine_state": "k string, v string",
}
KEYS: dict[str, list[str]] = {
    "candles": ["symbol", "timeframe", "open_time"],
    "funding_rates": ["symbol", "funding_time"],
    "premium_index_klines": ["symbol", "timeframe", "open_time"],
    "open_interest": ["symbol", "timeframe", "timestamp"],
    "data_sync_state": ["dataset", "symbol", "timeframe"],
    "execution_engine_state": ["k"],
}
TIME = {"candles": "open_time", "funding_rates": "funding_time", "premium_index_klines": "open_time", "open_interest": "timestamp"}


@dataclass
class Store:
    """Parquet tables below one folder. Writers of one table must take turns, as with any plain files."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def exists(self, table: str) -> bool:
        try:
            self.spark.read.parquet(self.path(table))
        except AnalysisException:
            return False
        return True

    def tables(self) -> list[str]:
        """The names of the tables that were written, sorted."""
        return sorted(t for t in (*SCHEMAS, "features") if self.exists(t))

    def read(self, table: str) -> DataFrame:
        """The table; empty with its schema if it was never written."""
        if self.exists(table):
            return self.spark.read.parquet(self.path(table))
        return self.spark.createDataFrame([], SCHEMAS[table])

    def scan(self, table: str, symbols: list[str] | None = None, timeframe: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Rows of symbols, timeframe and time range (both ends count); all three conditions reach the files."""
        rows, at = self.read(table), TIME[table]
        if symbols is not None:
            rows = rows.where(F.col("symbol").isin(symbols))
        if timeframe is not None:
            rows = rows.where(F.col("timeframe") == timeframe)
        if start is not None:
            rows = rows.where(F.col(at) >= start)
        if end is not None:
            rows = rows.where(F.col(at) <= end)
        if table == "premium_index_klines":
            rows = rows.withColumns({"volume": F.lit(0.0), "quote_volume": F.lit(0.0)})
        return rows

    def insert_new(self, table: str, batch: DataFrame) -> int:
        """Appends the rows whose key is not there yet; of equal keys in the batch one stays. How many were added."""
        fresh = cut(self.fresh(table, batch))
        self.append(table, fresh)
        return fresh.count()

    def fresh(self, table: str, batch: DataFrame) -> DataFrame:
        """The rows of batch, in the table's columns, whose key the table lacks; of equal keys one stays."""
        keys, fields = KEYS[table], [x.split(" ") for x in SCHEMAS[table].split(", ")]
        own = batch.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).dropDuplicates(keys)
        return own.join(self.read(table).select(*keys), keys, "left_anti").select(*[n for n, _ in fields])

    def append(self, table: str, rows: DataFrame) -> None:
        parts = ["symbol"] if "symbol" in KEYS[table] and table != "data_sync_state" else []
        rows.write.mode("append").partitionBy(*parts).parquet(self.path(table))

    def replace_features(self, frame: DataFrame) -> None:
        """Writes the frame's symbols anew and leaves other symbols' partitions alone."""
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(self.path("features"))

    def load_features(self, symbols: list[str]) -> DataFrame:
        """Feature rows of symbols. Without a table, or without rows of them, a warning and an empty frame."""
        if not self.exists("features"):
            warnings.warn("no feature table", stacklevel=2)
            return self.spark.createDataFrame([], "symbol string, ts bigint")
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path("features")).where(F.col("symbol").isin(symbols))
        if rows.isEmpty():
            warnings.warn(f"no features of {', '.join(symbols)}", stacklevel=2)
        return rows

    def candles_until(self, symbols: list[str], timeframe: str, step_ms: int, until: int | None = None) -> DataFrame:
        """Bars for a back-test: prices and volume as numbers, close_time, rows that lack one of them or lie behind ``until`` left out, in order."""
        rows = numbers(self.scan("candles", symbols, timeframe, end=until), ["open", "high", "low", "close", "volume"])
        rows = rows.withColumn("close_time", F.col("open_time") + step_ms)
        return rows.na.drop(subset=["open_time", "open", "high", "low", "close", "volume"]).orderBy("symbol", "open_time")

    def bounds(self, table: str) -> DataFrame:
        """First and last time and rows by symbol (and timeframe)."""
        by = [k for k in KEYS[table] if k != TIME[table]]
        return self.read(table).groupBy(*by).agg(F.min(TIME[table]).alias("first"), F.max(TIME[table]).alias("last"), F.count("*").alias("n"))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows replace those of the same key. Small keyed tables only: the table is written anew."""
        keys = KEYS[table]
        kept = self.read(table).join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*[x.split(" ")[0] for x in SCHEMAS[table].split(", ")]))
        self.rewrite(table, kept)

    def delete(self, table: str, rows: DataFrame) -> None:
        self.rewrite(table, self.read(table).join(rows.select(*KEYS[table]), KEYS[table], "left_anti"))

    def rewrite(self, table: str, rows: DataFrame) -> None:
        """Writes beside the table first, as rows may be read from it."""
        rows.write.mode("overwrite").parquet(self.path(f"{table}__next"))
        self.spark.read.parquet(self.path(f"{table}__next")).write.mode("overwrite").parquet(self.path(table))


def numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns as doubles; what is no number becomes NULL."""
    return rows.withColumns({c: F.col(c).try_cast("double") for c in columns})


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def sync(store: Store, table: str, symbol: str, timeframe: str, step_ms: int, start: int, end: int, fetch) -> int:
    """Brings one series up to date: from behind its last row (or start) to end. How many rows were added.

    fetch(start, end) gives a DataFrame. After an empty answer the state remembers what was asked for, so that it is not asked again;
    a failed fetch adds nothing.
    """
    spark, at = store.spark, TIME[table]
    key = spark.createDataFrame([(table, symbol, timeframe)], "dataset string, symbol string, timeframe string")
    own = store.scan(table, [symbol], timeframe if "timeframe" in KEYS[table] else None)
    last = own.agg(F.max(at).alias("t")).first()["t"]
    start = start if last is None else last + step_ms
    state = store.read("data_sync_state").join(key, KEYS["data_sync_state"], "left_semi").first()
    if state is not None:
        start = max(start, state["last_checked_ts"] + step_ms)
        if start >= state["empty_since_ts"] and end < state["last_checked_ts"] + step_ms:
            return 0
    if start > end:
        return 0
    try:
        batch = fetch(start, end)
        latest = batch.agg(F.max(at).alias("t")).first()["t"]
    except OSError:
        return 0
    added = store.insert_new(table, batch)
    if added:
        store.delete("data_sync_state", key)
        return added
    since = start if latest is None else max(start, latest + step_ms)
    store.upsert("data_sync_state", key.withColumns({"empty_since_ts": F.lit(since).cast("long"), "last_checked_ts": F.lit(end).cast("long")}))
    return 0


SERIES = ["symbol", "timeframe"]


def series_windows(wanted: DataFrame, marks: DataFrame, state: DataFrame, most: int = 1000) -> DataFrame:
    """(symbol, timeframe, step_ms, k, start, end): what has to be asked for, for all series in one plan, as windows of at most ``most`` bars, both ends included.

    wanted: (symbol, timeframe, step_ms, start, end) and, where known, ``listed``, before which nothing is asked for. marks: (symbol, last),
    with timeframe where the table has one: the last time stored. state: (symbol, timeframe, last_checked_ts): up to where an earlier
    answer was empty. A series begins behind the later of both; one that is up to date has no window. Null ends have none, null starts begin behind the
    mark only. One row a series is joined, whatever the tables' sizes.
    """
    if "listed" in wanted.columns:
        wanted = wanted.withColumn("start", F.greatest("start", "listed"))
    by = [c for c in SERIES if c in marks.columns]
    rows = wanted.select(*SERIES, "step_ms", "start", "end").join(marks.select(*by, "last"), by, "left").join(state.select(*SERIES, "last_checked_ts"), SERIES, "left")
    behind = F.greatest(F.coalesce(F.col("last") + F.col("step_ms"), F.col("start")), F.col("last_checked_ts") + F.col("step_ms"))
    rows = rows.withColumn("start", behind).where("start <= end")
    width = F.col("step_ms") * max(most, 1)
    rows = rows.select(*SERIES, "step_ms", "end", F.posexplode(F.sequence(F.col("start"), F.col("end"), width)).alias("k", "start"))
    return rows.select(*SERIES, "step_ms", "k", "start", F.least(F.col("start") + F.col("step_ms") * (max(most, 1) - 1), F.col("end")).alias("end"))


def sync_all(store: Store, table: str, wanted: DataFrame, fetch, most: int = 1000) -> DataFrame:
    """Brings all wanted series of a table up to date at once: (symbol, timeframe, start, end, added, failed) of every series that was asked for.

    fetch(windows) gives the table's columns for all windows; a row without a time says that a window of its series failed. Such a series
    adds nothing and its state stays. A series that answered but brought nothing new is remembered as checked up to its end, and
    one that did is forgotten there. The jobs are as many for a thousand series as for one; answers are fetched once, into the shared folder.
    ``wanted`` names a series once.
    """
    at, by = TIME[table], [k for k in KEYS[table] if k != TIME[table]]
    marks = store.read(table).groupBy(*by).agg(F.max(at).alias("last"))
    state = store.read("data_sync_state")
    windows = cut(series_windows(wanted, marks, state.where(F.col("dataset") == table), most))
    answers = cut(fetch(windows))
    failed = answers.where(F.col(at).isNull()).select(*by).distinct()
    fresh = cut(store.fresh(table, answers.where(F.col(at).isNotNull()).join(failed, by, "left_anti")))
    asked = windows.groupBy(*SERIES, "step_ms").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    latest = answers.groupBy(*by).agg(F.max(at).alias("latest"), F.max(F.col(at).isNull()).alias("failed"))
    added = fresh.groupBy(*by).agg(F.count("*").alias("added"))
    result = cut(asked.join(latest, by, "left").join(added, by, "left").na.fill(0, ["added"]).na.fill(False, ["failed"]))
    store.append(table, fresh)
    since = F.greatest("start", F.col("latest") + F.col("step_ms"))
    empty = result.where("added = 0 and not failed").select(F.lit(table).alias("dataset"), *SERIES, since.alias("empty_since_ts"), F.col("end").alias("last_checked_ts"))
    told = result.where("not failed").select(F.lit(table).alias("dataset"), *SERIES)
    store.rewrite("data_sync_state", state.join(told, KEYS["data_sync_state"], "left_anti").unionByName(empty))
    return result.select(*SERIES, "start", "end", "added", "failed")
