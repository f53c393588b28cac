"""Classifier metrics over (y, p_long[, p_short]) rows: conditional sums and windows, nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row, or one a group of ``keys``: tp, tn, fp, fn, accuracy, balanced_accuracy, f1_macro, mcc, base_rate of y in {0, 1} against p_long >= 0.5."""
    hit, y = F.col("p_long") >= 0.5, F.col("y") == 1
    keys = keys or []
    c = rows.groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.avg("y").alias("base_rate"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    f1 = lambda t, a, b: _safe(2 * t, 2 * t + a + b)
    norm = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(*keys, "tp", "tn", "fp", "fn", _safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((_safe(tp, tp + fn) + _safe(tn, tn + fp)) / 2).alias("balanced_accuracy"), ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("f1_macro"), _safe(tp * tn - fp * fn, norm).alias("mcc"), "base_rate")


def ranking(rows: DataFrame, stretches: int = 256) -> DataFrame:
    """One row: roc_auc (NULL with one class) by average ranks, average_precision by steps over distinct scores.

    Rows are first counted by distinct score. The scores are cut at approximate quantiles into stretches, which are ordered
    apart; a stretch takes over the sums of those above it, a row a stretch. Where the cuts lie doesn't change the result.
    """
    by = rows.groupBy("p_long").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    shares = [k / stretches for k in range(1, stretches)]
    cuts = sorted(set(rows.agg(F.percentile_approx("p_long", shares, 5 * stretches)).first()[0] or [])) if shares else []
    place = F.array_position(F.array_sort(F.array(*map(F.lit, cuts), F.col("p_long"))), F.col("p_long"))  # how many cuts lie below, and 1
    by = by.withColumn("stretch", F.coalesce(place, F.lit(0)))
    above = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = by.groupBy("stretch").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    carried = totals.select("stretch", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")])
    down = Window.partitionBy("stretch").orderBy(F.desc("p_long")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).join(F.broadcast(carried), "stretch")  # a row a stretch
    run = run.withColumn("tp", F.col("tp") + F.col("p_above")).withColumn("fp", F.col("fp") + F.col("n_above"))
    pos, neg = F.sum("pos"), F.sum("neg")
    # pairs of a positive and a negative in the right order: negatives below a score, and half of those at it
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    auc = F.try_divide(pairs, (pos * neg).cast("double"))
    precision = F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), pos.cast("double"))
    return run.agg(auc.alias("roc_auc"), precision.alias("average_precision"))


def levels(configured: float = 0.5) -> tuple[float, ...]:
    """The usual confidence levels and the configured one (0.5 at least, two decimals)."""
    return tuple(sorted({round(max(0.5, configured), 2), 0.55, 0.6, 0.65, 0.7}))


def thresholds(rows: DataFrame, levels: tuple[float, ...] = (0.55, 0.6, 0.65, 0.7)) -> DataFrame:
    """A row a threshold: rows, coverage, signals and precisions; where both sides pass, short wins."""
    each = rows.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in levels])))
    short, long_ = F.col("p_short") >= F.col("threshold"), (F.col("p_long") >= F.col("threshold")) & ~(F.col("p_short") >= F.col("threshold"))
    y = F.col("y") == 1
    c = each.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(long_).alias("long_signals"), F.count_if(short).alias("short_signals"), F.count_if(long_ & y).alias("long_tp"), F.count_if(short & ~y).alias("short_tp"), F.count_if(y).alias("longs"), F.count_if(~y).alias("shorts"))
    taken = F.col("long_signals") + F.col("short_signals")
    return c.select("threshold", taken.alias("signals"), _safe(taken, F.col("n")).alias("coverage"), "long_signals", "short_signals", (F.col("n") - taken).alias("no_trade"), F.try_divide(F.col("long_tp") + F.col("short_tp"), taken).alias("signal_accuracy"), F.try_divide("long_tp", "long_signals").alias("long_precision"), F.try_divide("short_tp", "short_signals").alias("short_precision"), _safe(F.col("long_tp"), F.col("longs")).alias("long_recall_all"), _safe(F.col("short_tp"), F.col("shorts")).alias("short_recall_all"))


def stability(folds: DataFrame, metric: str = "accuracy") -> DataFrame:
    """One row: population deviation and range of a metric over folds."""
    return folds.agg(F.stddev_pop(metric).alias(f"{metric}_std"), (F.max(metric) - F.min(metric)).alias(f"{metric}_range"))


def importances(rows: DataFrame) -> DataFrame:
    """Of (fold, feature, gain): mean, sample deviation (0 with one fold), how often in the first 10 and 20, and in how many folds above 0."""
    ranked = rows.withColumn("place", F.rank().over(Window.partitionBy("fold").orderBy(F.desc("gain"))))
    return ranked.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("std_gain"), F.count_if(F.col("place") <= 10).alias("top10"), F.count_if(F.col("place") <= 20).alias("top20"), F.count_if(F.col("gain") > 0).alias("nonzero"))


def best_features(ranked: DataFrame, k: int = 20) -> DataFrame:
    """The k features of largest mean gain of ``importances``, with their place; equal gains by name."""
    best = ranked.orderBy(F.desc("mean_gain"), "feature").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_gain"), "feature")))


def profile(frame: DataFrame) -> DataFrame:
    """Per symbol: rows, distinct times, first and last time, and how many targets of each kind."""
    return frame.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_distinct("ts").alias("n_ts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("Target") == 1).alias("longs"), F.count_if(F.col("Target") == -1).alias("shorts"), F.count_if(F.col("Target") == 0).alias("flats"))
