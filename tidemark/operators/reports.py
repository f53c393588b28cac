"""Reports over trades and equity marks: (run_id, kind, ts, symbol, direction, reason, pnl_pct, pnl_abs, commission, equity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def month(ts: str) -> F.Column:
    """The calendar month (UTC) of a time in milliseconds, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / DAY_MS).cast("int")), "yyyy-MM")


def by_month(rows: DataFrame) -> DataFrame:
    """A row for each month in which a bar was traded on, also without trades; nothing is traded on the first bar of a run."""
    first = rows.where("kind = 'equity'").groupBy("run_id").agg(F.min("ts").alias("first"))
    seen = rows.join(first, "run_id", "left").where("kind = 'trade' or ts > first")
    spine = seen.select("run_id", month("ts").alias("month")).distinct()
    trades = rows.where("kind = 'trade'").groupBy("run_id", month("ts").alias("month")).agg(F.sum("pnl_abs").alias("pnl_abs"), F.count("*").alias("trades"), F.count_if(F.col("pnl_pct") > 0).alias("wins"))
    out = spine.join(trades, ["run_id", "month"], "left").na.fill(0)
    return out.withColumn("losses", F.col("trades") - F.col("wins"))


def by_symbol(rows: DataFrame) -> DataFrame:
    t = rows.where("kind = 'trade'").groupBy("run_id", "symbol").agg(F.count("*").alias("trades"), F.count_if(F.col("reason") == "TP").alias("tp"), F.count_if(F.col("reason") == "SL").alias("sl"), F.count_if(F.col("pnl_abs") > 0).alias("wins"), F.sum("pnl_abs").alias("pnl_abs"))
    return t.withColumn("winrate", F.col("wins") / F.col("trades") * 100)


def by_direction(rows: DataFrame) -> DataFrame:
    """Both directions, also without trades."""
    both = rows.select("run_id").distinct().withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    t = rows.where("kind = 'trade'").groupBy("run_id", "direction").agg(F.count("*").alias("trades"), F.count_if(F.col("pnl_abs") > 0).alias("wins"), F.sum("pnl_abs").alias("pnl_abs"))
    return both.join(t, ["run_id", "direction"], "left").na.fill(0)


def totals(rows: DataFrame, balance: float) -> DataFrame:
    """A row a run: trades, wins, fees, pnl, return, expectancy, profit factor (infinite without losses, 0 without trades)."""
    pnl = F.col("pnl_abs")
    t = rows.groupBy("run_id").agg(F.count_if(F.col("kind") == "trade").alias("trades"), F.count_if(pnl > 0).alias("wins"), F.coalesce(F.sum("commission"), F.lit(0.0)).alias("fees"), F.coalesce(F.sum("pnl_abs"), F.lit(0.0)).alias("pnl_abs"), F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(pnl < 0, -pnl)), F.lit(0.0)).alias("lost"))
    factor = F.when(F.col("trades") == 0, 0.0).when(F.col("lost") > 0, F.try_divide("won", "lost")).otherwise(float("inf"))
    return t.select("run_id", "trades", "wins", "fees", "pnl_abs", (F.col("pnl_abs") / balance * 100).alias("return_pct"), F.coalesce(F.try_divide("pnl_abs", "trades"), F.lit(0.0)).alias("expectancy"), factor.alias("profit_factor"))


def drawdown(rows: DataFrame, balance: float) -> DataFrame:
    """(run_id, max_drawdown) in percent of the running peak, which starts at the balance."""
    w = Window.partitionBy("run_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = rows.where("kind = 'equity'").withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(balance)))
    return e.groupBy("run_id").agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("max_drawdown"))


def daily_equity(rows: DataFrame) -> DataFrame:
    """(run_id, day, equity, change): the last mark of each calendar day, carried over days without any."""
    e = rows.where("kind = 'equity'").groupBy("run_id", F.floor(F.col("ts") / DAY_MS).alias("day")).agg(F.max_by("equity", "i").alias("equity"))
    spine = e.groupBy("run_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("run_id", F.explode(F.sequence("a", "b")).alias("day"))
    w = Window.partitionBy("run_id").orderBy("day")
    filled = spine.join(e, ["run_id", "day"], "left").withColumn("equity", F.last("equity", ignorenulls=True).over(w))
    return filled.withColumn("change", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)


def risk(rows: DataFrame, balance: float | None = None) -> DataFrame:
    """(run_id, sharpe, sortino, cagr) of the daily equity, with a balance also calmar (cagr over the largest drawdown); 0 where they are not defined."""
    d = daily_equity(rows)
    a = d.groupBy("run_id").agg(F.avg("change").alias("m"), F.stddev_samp("change").alias("s"), F.stddev_samp(F.when(F.col("change") < 0, F.col("change"))).alias("down"), F.count("change").alias("n"), F.min_by("equity", "day").alias("first"), F.max_by("equity", "day").alias("last"), (F.max("day") - F.min("day")).alias("days"))
    fine = (F.col("n") > 1) & (F.col("s") > 0)
    year = F.sqrt(F.lit(365.0))
    zero = F.lit(0.0)
    days = F.try_divide(F.lit(365.0), F.col("days"))
    cagr = F.when(fine & (F.col("days") > 0), F.pow(F.try_divide("last", "first"), days) - 1).otherwise(zero)
    sharpe = F.when(fine, F.try_divide("m", "s") * year).otherwise(zero)
    sortino = F.coalesce(F.when(fine & (F.col("down") > 0), F.try_divide("m", "down") * year), zero)
    out = a.select("run_id", sharpe.alias("sharpe"), sortino.alias("sortino"), cagr.alias("cagr"))
    if balance is None:
        return out
    calmar = F.coalesce(F.when(F.col("max_drawdown") > 0, F.try_divide("cagr", F.col("max_drawdown") / 100)), zero)
    return out.join(drawdown(rows, balance), "run_id", "left").withColumn("calmar", calmar).drop("max_drawdown")
