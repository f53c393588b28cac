"""Registered queries of the analytics operators: name to (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.dialect import DUCKDB, doubles, full, zscore
from ..functions.registry import Feature, Parameter, Registry
from ..operators import feature_frame, labels, metrics, reports, simulator, training, validation
from ..operators.asof import asof
from ..operators.lineage import cut
from ..sources import bars, exchange, tables
from ..streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
FLAGSHIP = "features_all"
BENCHMARK = "purchase"
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    """Registers a query under a name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """Values to DIGITS decimals (and -0 as 0), so that engines that add in another order agree."""
    return df.select(*keep, *[(F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c) for c in values])


def sql_rounded(values: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in values)


_PARTS, _LAST = feature_frame.duckdb_frame(BENCHMARK)
FRAME_SQL = "WITH RECURSIVE " + ",\n".join(_PARTS)


def features_sql(names: list[str]) -> str:
    return f"{FRAME_SQL}\nSELECT symbol, ts, {sql_rounded(names)} FROM {_LAST}"


def _block(names: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = feature_frame.from_events(table(spark, sf_dir, "events"), BENCHMARK)
        return rounded(frame, ["symbol", "ts"], names)

    return run


QUERIES[FLAGSHIP] = (_block(sorted(fx.NAMES)), features_sql(sorted(fx.NAMES)))
for _name, _names in fx.BLOCKS.items():
    QUERIES[f"features_{_name}"] = (_block(sorted(_names)), features_sql(sorted(_names)))


# A user's own features

_OWN = ["close_zscore", "rsi_mean", "zscore_gap", "breadth_push"]


def own_features() -> Registry:
    """Four features that no part of the library knows: two with a window, one on both of them and held back, one on an interaction."""
    n = Parameter("zscore_bars", 20, 5, 200)
    return Registry().register(
        Feature("zscore_gap", "own", "close_zscore - (rsi_mean - 50) / {scale}", (Parameter("scale", 25.0, 1.0),), shift=2),
        Feature("close_zscore", "own", lambda zscore_bars: zscore("close", zscore_bars), (n,)),
        Feature("rsi_mean", "own", lambda rsi_bars: full("avg", "rsi_1h", rsi_bars), (Parameter("rsi_bars", 8, 2, 12),)),
        Feature("breadth_push", "own", "market_directional_pressure_1h * {weight}", (Parameter("weight", 2.0),)),
    )


_OWN_SQL = f"""{FRAME_SQL}, own1 AS (SELECT symbol, ts, market_directional_pressure_1h * 2.0 AS breadth_push,
CASE WHEN count(close) OVER z = 30 THEN (close - avg(close) OVER z) / nullif(stddev_samp(close) OVER z, 0) END AS close_zscore, CASE WHEN count(rsi_1h) OVER r = 12 THEN avg(rsi_1h) OVER r END AS rsi_mean FROM {_LAST}
WINDOW z AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING), r AS (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING)),
own2 AS (SELECT *, lag(close_zscore - (rsi_mean - 50) / 25.0, 2) OVER (PARTITION BY symbol ORDER BY ts) AS zscore_gap FROM own1) SELECT symbol, ts, {sql_rounded(_OWN)} FROM own2"""


@query("registered_features", _OWN_SQL)
def registered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a user's own beside the catalogue, with one window set to 30 bars and one moved to its bound of 12."""
    frames = feature_frame.frames_of(table(spark, sf_dir, "events"))
    return rounded(feature_frame.build_with(own_features(), _OWN, {"zscore_bars": 30, "rsi_bars": 90}, frames, BENCHMARK), ["symbol", "ts"], _OWN)


# Bars and series


def _bars(step_ms: int) -> Query:
    return lambda spark, d: bars.candles(table(spark, d, "events"), step_ms).select("symbol", "open_time", "ts", "open", "high", "low", "close", "volume", F.round("quote_volume", DIGITS).alias("quote_volume"))


for _name, _step in (("candles_1h", bars.HOUR_MS), ("candles_4h", 4 * bars.HOUR_MS)):
    QUERIES[_name] = (_bars(_step), f"SELECT symbol, open_time, ts, open, high, low, close, volume, round(quote_volume, {DIGITS}) AS quote_volume FROM ({bars.duckdb(_step)})")
for _column, _make in (("funding_rate", bars.funding_rates), ("premium_index_close", bars.premium_index), ("open_interest", bars.open_interest)):
    QUERIES[f"series_{_column}"] = (lambda spark, d, make=_make, c=_column: rounded(make(table(spark, d, "events")), ["symbol", "ts"], [c]), f"SELECT symbol, ts, {sql_rounded([_column])} FROM ({bars.duckdb_series(_column)})")


@query(
    "asof_events_candles",
    f"SELECT e.event_id, c.ts AS bar_ts, c.close AS bar_close FROM (SELECT event_id, event_type AS symbol, CAST(epoch_ms(ts) AS BIGINT) AS ts FROM events) e ASOF LEFT JOIN ({bars.duckdb()}) c ON c.symbol = e.symbol AND c.ts <= e.ts",
)
def asof_events_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last bar closed before it; keys are split by day, so a hot symbol is spread over tasks."""
    events = table(spark, sf_dir, "events")
    left = events.select("event_id", F.col("event_type").alias("symbol"), bars.epoch_ms(F.col("ts").cast("timestamp_ntz")).cast("long").alias("ts"))
    right = bars.candles(events).select("symbol", "ts", F.col("ts").alias("bar_ts"), F.col("close").alias("bar_close"))
    return asof(left, right, "symbol", "ts", ["bar_ts", "bar_close"], bucket=validation.DAY_MS).select("event_id", "bar_ts", "bar_close")


@query(
    "tumbling_bars",
    f"SELECT symbol, open_time, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM ({bars.duckdb(4 * bars.HOUR_MS)})",
)
def tumbling_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan on a table."""
    return live.tumbling_bars(table(spark, sf_dir, "events")).withColumn("open_time", F.unix_millis("open_time"))


@query(
    "payload_klines",
    f"SELECT symbol, open_time, open, high, low, close, volume FROM ({bars.duckdb()})",
)
def payload_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars packed as exchange answers of a symbol and day, and mapped back."""
    c = bars.candles(table(spark, sf_dir, "events"))
    row = F.array(*[F.col(x).cast("string") for x in ("open_time", "open", "high", "low", "close", "volume")], F.lit("0"), F.col("quote_volume").cast("string"))
    payloads = c.groupBy("symbol", F.floor(F.col("open_time") / validation.DAY_MS)).agg(F.to_json(F.collect_list(row)).alias("payload")).select("symbol", "payload")
    return exchange.klines(payloads, "b").select("symbol", "open_time", "open", "high", "low", "close", "volume")


@query(
    "request_windows",
    "SELECT CAST(i AS INTEGER) AS k, a + i * 36000000 AS start, least(a + i * 36000000 + 32400000, b) AS \"end\" FROM (SELECT a, b, unnest(range(0, (b - a) // 36000000 + 1)) AS i FROM (SELECT min(open_time) AS a, max(open_time) AS b FROM (" + bars.duckdb() + ")))",
)
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten bars over the table's time range."""
    r = bars.candles(table(spark, sf_dir, "events")).agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).first()
    return exchange.request_windows(spark, r["a"], r["b"], bars.HOUR_MS, 10)


_MONTH, _CHECKED, _WIDTH = 30 * 86_400_000, 5 * 86_400_000, 100
_SYNC_SQL = f"""WITH c AS ({bars.duckdb()}), r AS (SELECT min(open_time) AS a, max(open_time) + {_MONTH} AS b FROM c),
m AS (SELECT symbol, max(open_time) AS last, count(*) AS n FROM c GROUP BY symbol),
w AS (SELECT symbol, b, CASE WHEN symbol = '{BENCHMARK}' THEN a ELSE last + {bars.HOUR_MS} END AS s, CASE WHEN n % 2 = 1 THEN last + {_CHECKED + bars.HOUR_MS} END AS seen FROM m, r),
v AS (SELECT symbol, b, greatest(s, seen) AS s FROM w)
SELECT symbol, '1h' AS timeframe, CAST(i AS INTEGER) AS k, s + i * {_WIDTH * bars.HOUR_MS} AS start, least(s + i * {_WIDTH * bars.HOUR_MS} + {(_WIDTH - 1) * bars.HOUR_MS}, b) AS "end"
FROM (SELECT symbol, s, b, unnest(range(0, (b - s) // {_WIDTH * bars.HOUR_MS} + 1)) AS i FROM v WHERE s <= b)"""


@query("sync_windows", _SYNC_SQL)
def sync_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a month's sync of all series at once has to ask for: the benchmark was never stored, and symbols with an odd number of bars had an empty answer of five days."""
    of = bars.candles(table(spark, sf_dir, "events")).groupBy("symbol").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count("*").alias("n"))
    of = cut(of.withColumn("timeframe", F.lit("1h")))
    span = of.agg(F.min("first").alias("start"), (F.max("last") + _MONTH).alias("end"))
    wanted = of.select("symbol", "timeframe", F.lit(bars.HOUR_MS).cast("long").alias("step_ms")).join(F.broadcast(span))
    state = of.where("n % 2 = 1").select("symbol", "timeframe", (F.col("last") + _CHECKED).alias("last_checked_ts"))
    return tables.series_windows(wanted, of.where(F.col("symbol") != BENCHMARK), state, _WIDTH).drop("step_ms")


# Labels, folds, weights

_LABEL_PARTS, _LABELLED = feature_frame.duckdb_levels(_LAST, labels.label_levels(labels.Barriers(), DUCKDB), "lab")
LABEL_SQL = FRAME_SQL + ",\n" + ",\n".join(_LABEL_PARTS)
LABEL_INPUTS = ["realized_vol_1h", "rsi_1h", "market_breadth_ema_fast_slow_1h", "ema_slope_4h", "ema_fast_slow", "volume_ratio_1h"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.resolve(LABEL_INPUTS)
    return labels.label(feature_frame.from_events(table(spark, sf_dir, "events"), BENCHMARK, wanted))


_LABEL_VALUES = ["barrier_stop_pct", "barrier_take_pct", "long_pnl", "short_pnl"]


@query("triple_barrier_labels", f"{LABEL_SQL} SELECT symbol, ts, CAST(horizon AS INTEGER) AS horizon, CAST(Target AS INTEGER) AS Target, {sql_rounded(_LABEL_VALUES)} FROM {_LABELLED}")
def triple_barrier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons, barriers, outcomes and labels of every bar."""
    return rounded(labelled(spark, sf_dir), ["symbol", "ts", F.col("horizon").cast("int").alias("horizon"), F.col("Target").cast("int").alias("Target")], _LABEL_VALUES)


@query("symbol_profile", f"{LABEL_SQL} SELECT symbol, count(*) AS n_rows, count(DISTINCT ts) AS n_ts, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) FILTER (Target = 1) AS BIGINT) AS longs, CAST(count(*) FILTER (Target = -1) AS BIGINT) AS shorts, CAST(count(*) FILTER (Target = 0) AS BIGINT) AS flats FROM {_LABELLED} GROUP BY symbol")
def symbol_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, times and targets of each symbol."""
    return metrics.profile(labelled(spark, sf_dir))


@query("final_training_rows", f"{LABEL_SQL} SELECT symbol, ts, {sql_rounded(LABEL_INPUTS)}, CAST(Target AS INTEGER) AS Target FROM {_LABELLED} WHERE rows_left >= 20 AND {' AND '.join(f'{c} IS NOT NULL' for c in LABEL_INPUTS + ['barrier_stop_pct'])}")
def final_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What training sees: no tail, no missing value."""
    rows = labels.finalise(labelled(spark, sf_dir), [*LABEL_INPUTS, "barrier_stop_pct"])
    return rows.select("symbol", "ts", *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in LABEL_INPUTS], F.col("Target").cast("int").alias("Target"))


_LINE = f"line AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM ({bars.duckdb()})))"


@query(
    "expanding_folds",
    f"WITH {_LINE}, f AS (SELECT *, n // 6 AS size, unnest([1, 2, 3, 4, 5]) AS fold FROM line), s AS (SELECT *, n - (6 - fold) * size AS start FROM f) SELECT CAST(fold AS INTEGER) AS fold, ts, CASE WHEN i >= start AND i < start + size THEN 'test' ELSE 'train' END AS role FROM s WHERE i >= start AND i < start + size OR i < start - CASE WHEN start > 20 THEN 20 ELSE 0 END",
)
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five expanding folds with a purge gap of twenty bars."""
    return validation.expanding_folds(bars.candles(table(spark, sf_dir, "events")), 5, 20)


_WEIGHT = "least(greatest(exp(-ln(2.0::DOUBLE) / 180 * d) * CASE WHEN d <= 60 THEN 1.5 ELSE 1.0 END * (1 + greatest(0.0, least((least(abs(coalesce(market_breadth_ema_fast_slow_1h, 0.5) * 2 - 1), 1.0) + tanh(abs(coalesce(ema_slope_4h, 0.0)) / 0.08)) / 2 * 0.18, 0.25))), 0.8), 1.35)"


@query("sample_weights", f"{LABEL_SQL} SELECT symbol, ts, round(CAST({_WEIGHT} AS DOUBLE), {DIGITS}) AS weight FROM (SELECT *, (max(ts) OVER () - ts) / 86400000.0::DOUBLE AS d FROM {_LABELLED})")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all labelled rows."""
    return rounded(validation.sample_weights(labelled(spark, sf_dir)), ["symbol", "ts"], ["weight"])


_SPLIT = f"""line AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {_LABELLED})),
    f AS (SELECT *, n // 6 AS size, unnest([1, 2, 3, 4, 5]) AS fold FROM line), s AS (SELECT *, n - (6 - fold) * size AS start FROM f),
    tr AS (SELECT s.fold, l.*, CAST(Target = 1 AS INTEGER) AS y FROM {_LABELLED} l JOIN s USING (ts) WHERE s.i < s.start - CASE WHEN s.start > 20 THEN 20 ELSE 0 END AND Target <> 0),
    num AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ts, symbol) AS r, count(*) OVER (PARTITION BY fold) AS n, (max(ts) OVER (PARTITION BY fold) - ts) / 86400000.0::DOUBLE AS d FROM tr),
    c AS (SELECT fold, n, k, greatest(1, least(CAST(floor(n * x) AS BIGINT), n - 1)) AS size FROM (SELECT DISTINCT fold, n FROM num), (VALUES (0, 0.15::DOUBLE), (1, 0.2), (2, 0.25), (3, 0.3), (4, 0.35), (5, 0.4)) v(k, x)),
    e AS (SELECT c.fold, c.n, k, size, sum(y) AS total, sum(y) FILTER (r > c.n - size) AS late FROM c JOIN num USING (fold) GROUP BY ALL),
    g AS (SELECT *, abs((total - late) / (n - size) - late / size) AS gap, late NOT IN (0, size) AND total - late NOT IN (0, n - size) AS two FROM e),
    best AS (SELECT fold, coalesce(arg_min(size, k) FILTER (two AND gap <= 0.08), arg_min(size, gap) FILTER (two), arg_min(size, k)) AS size FROM g GROUP BY fold)"""


@query(
    "fold_training_rows",
    f"""{LABEL_SQL}, {_SPLIT} SELECT CAST(fold AS INTEGER) AS fold, symbol, ts, y, round(CAST({_WEIGHT} AS DOUBLE), {DIGITS}) AS weight,
    CAST(CASE WHEN r > n - size THEN 1 WHEN r <= greatest(1, n - size - 20) THEN 0 ELSE 2 END AS INTEGER) AS use FROM num JOIN best USING (fold)""",
)
def fold_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fold's fit learns from, is stopped by, and leaves out between them, with its weights."""
    rows = cut(labelled(spark, sf_dir))
    train = training.directional(rows.join(validation.expanding_folds(rows).where("role = 'train'"), "ts"))
    used = training.used_rows(validation.sample_weights(train, by="fold"), 20)
    return used.select("fold", "symbol", "ts", F.col("y").cast("int").alias("y"), (F.round("weight", DIGITS) + F.lit(0.0)).alias("weight"), F.col("use").cast("int").alias("use"))


@query("winsorised", f"{LABEL_SQL}, q AS (SELECT {', '.join(f'quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}' for c in LABEL_INPUTS)} FROM {_LABELLED}) SELECT symbol, ts, {', '.join(f'round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, lo_{c}), hi_{c}) END, {DIGITS}) + 0.0 AS {c}' for c in LABEL_INPUTS)} FROM {_LABELLED}, q")
def winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features clipped to their first and last hundredth."""
    rows = cut(labelled(spark, sf_dir))  # read by each pass of the quantiles
    return rounded(validation.clipped(rows, validation.clip_bounds(rows, LABEL_INPUTS)), ["symbol", "ts"], LABEL_INPUTS)


# Metrics, on probabilities that are a fixed function of a feature

_P = "round(1.0 / (1.0 + exp(-((rsi_1h - 50.0) * 0.05))), 3)"
_SCORED = f"scored AS (SELECT CASE WHEN Target = 1 THEN 1 ELSE 0 END AS y, {doubles(_P)} AS p_long, 1 - {doubles(_P)} AS p_short FROM {_LABELLED} WHERE Target <> 0 AND rsi_1h IS NOT NULL)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).where("Target <> 0 and rsi_1h is not null").withColumn("p_long", F.expr(doubles(_P)))
    return rows.select(F.when(F.col("Target") == 1, 1).otherwise(0).alias("y"), "p_long", (1 - F.col("p_long")).alias("p_short"))


_CM = "c AS (SELECT count(*) FILTER (p_long >= 0.5 AND y = 1) AS tp, count(*) FILTER (p_long < 0.5 AND y = 0) AS tn, count(*) FILTER (p_long >= 0.5 AND y = 0) AS fp, count(*) FILTER (p_long < 0.5 AND y = 1) AS fn, avg(y) AS base_rate FROM scored)"
_METRICS = ["accuracy", "balanced_accuracy", "f1_macro", "mcc", "base_rate"]


@query(
    "classification_metrics",
    f"""{LABEL_SQL}, {_SCORED}, {_CM} SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round((tp + tn) / (tp + tn + fp + fn), {DIGITS}) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, {DIGITS}) AS balanced_accuracy,
    round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, {DIGITS}) AS f1_macro, round((tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), {DIGITS}) AS mcc, round(base_rate, {DIGITS}) AS base_rate FROM c""",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and the scores made of them."""
    return rounded(metrics.classification(scored(spark, sf_dir)), ["tp", "tn", "fp", "fn"], _METRICS)


@query(
    "ranking_metrics",
    f"""{LABEL_SQL}, {_SCORED}, d AS (SELECT p_long, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1), r AS (SELECT *, sum(pos) OVER (ORDER BY p_long DESC) AS tp, sum(neg) OVER (ORDER BY p_long DESC) AS fp FROM d),
    auc AS (SELECT sum(CASE WHEN a.p_long > b.p_long THEN a.pos * b.neg WHEN a.p_long = b.p_long THEN a.pos * b.neg / 2 ELSE 0 END) AS s FROM d a, d b)
    SELECT round((SELECT s FROM auc) / (sum(pos) * sum(neg)), {DIGITS}) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), {DIGITS}) AS average_precision FROM r""",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve and average precision."""
    return rounded(metrics.ranking(scored(spark, sf_dir)), [], ["roc_auc", "average_precision"])


_T_VALUES = ["coverage", "signal_accuracy", "long_precision", "short_precision", "long_recall_all", "short_recall_all"]


@query(
    "threshold_breakdown",
    f"""{LABEL_SQL}, {_SCORED}, e AS (SELECT *, p_short >= t AS s, p_long >= t AND NOT p_short >= t AS l FROM scored, (SELECT unnest([0.55::DOUBLE, 0.6, 0.65, 0.7]) AS t)),
    g AS (SELECT t AS threshold, count(*) AS n, count(*) FILTER (l) AS ls, count(*) FILTER (s) AS ss, count(*) FILTER (l AND y = 1) AS lt, count(*) FILTER (s AND y = 0) AS st, count(*) FILTER (y = 1) AS yl, count(*) FILTER (y = 0) AS ys FROM e GROUP BY t)
    SELECT threshold, CAST(ls + ss AS BIGINT) AS signals, round((ls + ss) / n, {DIGITS}) AS coverage, CAST(ls AS BIGINT) AS long_signals, CAST(ss AS BIGINT) AS short_signals, CAST(n - ls - ss AS BIGINT) AS no_trade, round((lt + st) / nullif(ls + ss, 0), {DIGITS}) AS signal_accuracy,
    round(lt / nullif(ls, 0), {DIGITS}) AS long_precision, round(st / nullif(ss, 0), {DIGITS}) AS short_precision, round(lt / yl, {DIGITS}) AS long_recall_all, round(st / ys, {DIGITS}) AS short_recall_all FROM g""",
)
def threshold_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by confidence threshold."""
    return rounded(metrics.thresholds(scored(spark, sf_dir)), ["threshold", "signals", "long_signals", "short_signals", "no_trade"], _T_VALUES)


# Reports, on the outcomes of all labelled bars as trades

_TRADES = f"t AS (SELECT 'r' AS run_id, 'trade' AS kind, ts, symbol, CASE WHEN Target = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN Target = 1 THEN long_pnl ELSE short_pnl END * 100 AS pnl_abs, 0.08::DOUBLE AS commission FROM {_LABELLED} WHERE Target <> 0)"


def outcome_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = F.when(F.col("Target") == 1, F.col("long_pnl")).otherwise(F.col("short_pnl"))
    t = labelled(spark, sf_dir).where("Target <> 0")
    return t.select(F.lit("r").alias("run_id"), F.lit("trade").alias("kind"), "ts", "symbol", F.when(F.col("Target") == 1, "LONG").otherwise("SHORT").alias("direction"), F.lit("TP").alias("reason"), won.alias("pnl_pct"), (won * 100).alias("pnl_abs"), F.lit(0.08).alias("commission"))


@query("report_by_month", f"{LABEL_SQL}, {_TRADES} SELECT strftime(make_timestamp(ts * 1000), '%Y-%m') AS month, round(sum(pnl_abs), 4) AS pnl_abs, CAST(count(*) AS BIGINT) AS trades, CAST(count(*) FILTER (pnl_abs > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (pnl_abs <= 0) AS BIGINT) AS losses FROM t GROUP BY 1")
def report_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_month(outcome_trades(spark, sf_dir)).select("month", F.round("pnl_abs", 4).alias("pnl_abs"), "trades", "wins", "losses")


@query("report_by_symbol", f"{LABEL_SQL}, {_TRADES} SELECT symbol, CAST(count(*) AS BIGINT) AS trades, CAST(count(*) FILTER (pnl_abs > 0) AS BIGINT) AS wins, round(sum(pnl_abs), 4) AS pnl_abs, round(count(*) FILTER (pnl_abs > 0) / count(*) * 100, 4) AS winrate FROM t GROUP BY 1")
def report_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_symbol(outcome_trades(spark, sf_dir)).select("symbol", "trades", "wins", F.round("pnl_abs", 4).alias("pnl_abs"), F.round("winrate", 4).alias("winrate"))


@query("report_by_direction", f"{LABEL_SQL}, {_TRADES} SELECT direction, CAST(count(*) AS BIGINT) AS trades, CAST(count(*) FILTER (pnl_abs > 0) AS BIGINT) AS wins, round(sum(pnl_abs), 4) AS pnl_abs FROM t GROUP BY 1")
def report_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_direction(outcome_trades(spark, sf_dir)).select("direction", "trades", "wins", F.round("pnl_abs", 4).alias("pnl_abs"))


@query("report_totals", f"{LABEL_SQL}, {_TRADES} SELECT CAST(count(*) AS BIGINT) AS trades, CAST(count(*) FILTER (pnl_abs > 0) AS BIGINT) AS wins, round(sum(commission), 4) AS fees, round(sum(pnl_abs), 4) AS pnl_abs, round(sum(pnl_abs), 4) AS return_pct, round(avg(pnl_abs), 4) AS expectancy, coalesce(round(sum(pnl_abs) FILTER (pnl_abs > 0) / -sum(pnl_abs) FILTER (pnl_abs < 0), 4), 'Infinity'::DOUBLE) AS profit_factor FROM t")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(outcome_trades(spark, sf_dir), 100.0).select("trades", "wins", *[F.round(c, 4).alias(c) for c in ("fees", "pnl_abs", "return_pct", "expectancy", "profit_factor")])


# Equity, which is a balance of 1000 and the outcomes so far of buying at every bar

_EQUITY = f"e AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, 1000.0::DOUBLE + sum(p) OVER (ORDER BY ts) AS equity FROM (SELECT ts, sum(long_pnl) AS p FROM {_LABELLED} WHERE Target <> 0 GROUP BY ts))"
_PEAK = "d AS (SELECT max((peak - equity) / peak * 100) AS max_drawdown FROM (SELECT equity, greatest(max(equity) OVER (ORDER BY i), 1000.0) AS peak FROM e))"
_DAILY = """last AS (SELECT ts // 86400000 AS day, arg_max(equity, i) AS equity FROM e GROUP BY 1), spine AS (SELECT unnest(range(a, b + 1)) AS day FROM (SELECT min(day) AS a, max(day) AS b FROM last)),
    filled AS (SELECT day, last_value(equity IGNORE NULLS) OVER (ORDER BY day) AS equity FROM spine LEFT JOIN last USING (day)), daily AS (SELECT day, equity, equity / lag(equity) OVER (ORDER BY day) - 1 AS change FROM filled)"""


def equity_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = labelled(spark, sf_dir).where("Target <> 0").groupBy("ts").agg(F.sum("long_pnl").alias("p")).withColumn("run_id", F.lit("r"))
    by = Window.partitionBy("run_id").orderBy("ts")
    return at.select("run_id", F.lit("equity").alias("kind"), "ts", (F.row_number().over(by) - 1).alias("i"), (F.lit(1000.0) + F.sum("p").over(by)).alias("equity"))


@query("equity_drawdown", f"{LABEL_SQL}, {_EQUITY}, {_PEAK} SELECT round(max_drawdown, 4) AS max_drawdown FROM d")
def equity_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fall below the running peak, in percent."""
    return reports.drawdown(equity_marks(spark, sf_dir), 1000.0).select(F.round("max_drawdown", 4).alias("max_drawdown"))


@query("daily_equity", f"{LABEL_SQL}, {_EQUITY}, {_DAILY} SELECT CAST(day AS BIGINT) AS day, round(equity, 4) AS equity, round(change, 6) AS change FROM daily")
def daily_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last mark of each day and its change."""
    return reports.daily_equity(equity_marks(spark, sf_dir)).select("day", F.round("equity", 4).alias("equity"), F.round("change", 6).alias("change"))


@query(
    "risk_figures",
    f"""{LABEL_SQL}, {_EQUITY}, {_PEAK}, {_DAILY}, a AS (SELECT avg(change) AS m, stddev_samp(change) AS s, stddev_samp(change) FILTER (change < 0) AS down, arg_min(equity, day) AS f, arg_max(equity, day) AS l, max(day) - min(day) AS days FROM daily),
    r AS (SELECT m / s * sqrt(365.0) AS sharpe, coalesce(m / down * sqrt(365.0), 0.0) AS sortino, pow(l / f, 365.0 / days) - 1 AS cagr FROM a)
    SELECT round(sharpe, 4) AS sharpe, round(sortino, 4) AS sortino, round(cagr, 4) AS cagr, round(CASE WHEN max_drawdown > 0 THEN cagr / (max_drawdown / 100) ELSE 0 END, 4) AS calmar FROM r, d""",
)
def risk_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe, Sortino, yearly growth and Calmar of the daily equity."""
    found = reports.risk(equity_marks(spark, sf_dir), 1000.0)
    return found.select(*[F.round(c, 4).alias(c) for c in ("sharpe", "sortino", "cagr", "calmar")])


_GAINS = f"g AS (SELECT CAST(ts // 86400000 % 3 + 1 AS INTEGER) AS fold, symbol || '_' || Target AS feature, CAST(count(*) AS DOUBLE) AS gain FROM {_LABELLED} GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY gain DESC) AS place FROM g)"


@query(
    "feature_importances",
    f"""{LABEL_SQL}, {_GAINS} SELECT feature, round(avg(gain), 6) AS mean_gain, round(coalesce(stddev_samp(gain), 0.0), 6) AS std_gain, CAST(count(*) FILTER (place <= 10) AS BIGINT) AS top10,
    CAST(count(*) FILTER (place <= 20) AS BIGINT) AS top20, CAST(count(*) FILTER (gain > 0) AS BIGINT) AS nonzero FROM k GROUP BY feature""",
)
def feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over folds, on counts of targets by symbol in place of a model's gains."""
    fold = (F.floor(F.col("ts") / validation.DAY_MS) % 3 + 1).cast("int")
    gains = labelled(spark, sf_dir).groupBy(fold.alias("fold"), F.concat_ws("_", "symbol", "Target").alias("feature")).agg(F.count("*").cast("double").alias("gain"))
    return rounded(metrics.importances(gains), ["feature", "top10", "top20", "nonzero"], ["mean_gain", "std_gain"])


@query("portfolio_simulation", None)
def portfolio_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of the timeline as runs of the simulator."""
    rows = labelled(spark, sf_dir).where("rsi_1h is not null").withColumn("p_long", F.expr(doubles(_P)))
    half = F.when(F.col("ts") < F.lit(1_705_363_200_000), "first").otherwise("second")
    signals = rows.select(half.alias("run_id"), "symbol", "ts", "p_long", (1 - F.col("p_long")).alias("p_short"), "barrier_stop_pct", "barrier_take_pct")
    c = bars.candles(table(spark, sf_dir, "events"))
    candles = c.select(F.when(F.col("ts") < F.lit(1_705_363_200_000), "first").otherwise("second").alias("run_id"), "symbol", "open_time", "open", "high", "low", "close")
    return simulator.simulate(simulator.steps(candles, signals, bars.HOUR_MS), simulator.Rules(balance=10_000.0))


@query("walk_forward_model", None)
def walk_forward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample probabilities of all folds, on every feature column, with the operator's defaults."""
    rows = cut(labels.label(feature_frame.from_events(table(spark, sf_dir, "events"), BENCHMARK)))
    columns = training.feature_columns(rows)
    rows = labels.finalise(rows, columns)
    return training.walk_forward(rows, columns)[0]
