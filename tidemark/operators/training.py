"""Directional classifier: boosted trees with early stopping, walk-forward predictions, importances.

The folds are fitted side by side: their rows are one table, and every step is a Spark job over all of them. The driver holds models, bounds and edges.
"""

from __future__ import annotations

from dataclasses import replace
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .boosting import EVAL, FIT, GAP, Model, Trees
from .lineage import cut
from .metrics import classification
from .quantiles import exact_quantiles
from .validation import Weights, eval_plans, expanding_folds, numbered, sample_weights

RESERVED = frozenset("symbol ts open high low close volume Target y weight horizon barrier_stop_pct barrier_take_pct long_pnl short_pnl next_open fold".split())


def feature_columns(frame: DataFrame, disabled: tuple[str, ...] = ()) -> list[str]:
    """Every numeric column that is not reserved or disabled."""
    return sorted(c for c, kind in frame.dtypes if kind in ("double", "float", "int", "bigint") and c not in RESERVED and c not in disabled)


def directional(frame: DataFrame) -> DataFrame:
    """Rows with a direction, y = 1 for long. Other targets than -1, 0 and 1 raise."""
    if not frame.where(~F.col("Target").isin(-1, 0, 1) | F.col("Target").isNull()).isEmpty():
        raise ValueError("unknown target")
    return frame.where("Target <> 0").withColumn("y", (F.col("Target") == 1).cast("double"))


def used_rows(train: DataFrame, gap: int, seen: dict[int, dict] | None = None) -> DataFrame:
    """train (fold, ts, symbol, y) with use: the last rows in time of a fold are EVAL, the ``gap`` rows before them GAP (fewer where little would be left), the others FIT."""
    plans = eval_plans(train) if seen is None else seen
    starts = train.sparkSession.createDataFrame([(k, p["rows"] - p["eval_size"]) for k, p in plans.items()], "fold int, start long")
    rows = numbered(train, "__r", "fold").join(F.broadcast(starts), "fold")  # a row a fold
    use = F.when(F.col("__r") > F.col("start"), EVAL).when(F.col("__r") <= F.greatest(F.lit(1), F.col("start") - gap), FIT).otherwise(GAP)
    return rows.withColumn("use", use).drop("__r", "start")


def fit_folds(train: DataFrame, columns: list[str], trees: Trees = Trees(), gap: int = 0, validated: bool = True, rounds: int | None = None) -> tuple[dict[int, Model], dict[int, int]]:
    """Models and their numbers of rounds by fold, of rows (fold, symbol, ts, y, weight, columns); folds with one direction have none.

    Boosting stops when the loss of a fold's last rows no longer falls. A fold whose best round is below ``least_rounds`` is fitted anew on all its
    rows, with as many rounds as the median of the earlier folds', ``refit_least`` at least, or ``refit_default`` if it is the first.
    """
    bounds = {k: tuple(v) for k, v in exact_quantiles(train, columns, [0.01, 0.99], "fold").items()}
    edges = boosting.edges_of(train, columns, bounds, trees.bins, "fold")
    models = {k: Model(columns, {c: bounds[k, c] for c in columns if (k, c) in bounds}, e) for k, e in edges.items()}
    if not models:
        return {}, {}
    rows = used_rows(train, gap) if validated else train.withColumn("use", F.lit(FIT))
    key = F.xxhash64("symbol", "ts").alias("key")
    blocks = boosting.blocks_of(rows.select(F.col("fold").alias("fit"), key, "y", "weight", "use", *[f"`{c}`" for c in columns]), models, trees)
    seeds = {k: trees.seed + k for k in models}
    if not validated:
        out = boosting.boost(blocks, models, trees, rounds or trees.rounds, False, seeds)
        return out, {k: len(m.trees) for k, m in out.items()}
    out = boosting.boost(blocks, models, trees, trees.rounds, True, seeds)
    used = {k: len(m.trees) for k, m in out.items()}
    weak = {k for k, n in used.items() if n < trees.least_rounds}
    if weak:  # trees do not depend on the number of rounds, so all are grown to the most that one may need, and cut
        most = max([trees.refit_least, trees.refit_default, *used.values()])
        anew = boosting.boost(blocks.map(lambda own: [b for b in own if b.fit in weak]), {k: models[k] for k in weak}, trees, most, False, seeds)
        earlier: list[int] = []
        for k in sorted(out):
            if k in weak:
                n = max(trees.refit_least, int(median(earlier)) if earlier else trees.refit_default)
                out[k] = replace(anew[k], trees=anew[k].trees[:n], losses=out[k].losses)
                used[k] = len(out[k].trees)
            earlier.append(used[k])
    blocks.unpersist()
    return out, used


def predict(models: dict[int, Model], rows: DataFrame, fit: str = "fold") -> DataFrame:
    """rows, of folds that have a model, with p_short and p_long."""
    return boosting.probabilities(rows.where(F.col(fit).isin(list(models))), models, fit, rows.columns)


def walk_forward(
    frame: DataFrame, columns: list[str], folds: int = 5, gap: int = 20, trees: Trees = Trees(), weights: Weights = Weights(), cuts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """((symbol, ts, Target, p_short, p_long, fold) of every test row, (fold, feature, gain)).

    Folds are cut on the times of all rows, or given as ``cuts`` (fold, ts, role), such as those of ``month_folds``; models learn from directional
    train rows, with bounds and weights of their own, and predict all test rows. A fold whose train rows have one direction only has no rows; without any other, both results are empty.
    """
    spark, frame = frame.sparkSession, cut(frame)
    cuts = expanding_folds(frame, folds, gap) if cuts is None else cuts
    dealt = cut(frame.join(cuts, "ts"))
    train = directional(dealt.where("role = 'train'"))
    train = cut(sample_weights(train, weights, "fold"))
    both = [r["fold"] for r in train.groupBy("fold").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a < b").collect()]  # a row a fold
    models, _ = fit_folds(train.where(F.col("fold").isin(both)), columns, trees, gap) if both else ({}, {})
    tested = dealt.where("role = 'test'").select("symbol", "ts", "Target", "fold", *[f"`{c}`" for c in columns if c not in ("symbol", "ts", "Target", "fold")])
    if models:
        tested = predict(models, tested)
    else:
        tested = tested.limit(0).withColumns({"p_short": F.lit(0.0), "p_long": F.lit(0.0)})
    gains = [(k, c, float(g)) for k, m in sorted(models.items()) for c, g in zip(columns, m.gains(), strict=True)]
    return tested.select("symbol", "ts", "Target", "p_short", "p_long", "fold"), spark.createDataFrame(gains, "fold int, feature string, gain double")


def fold_details(predictions: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row a fold: its test rows and directional rows, first and last test time, train times, and its out-of-sample metrics."""
    own = predictions.where("Target <> 0").withColumn("y", (F.col("Target") == 1).cast("int"))
    rows = predictions.groupBy("fold").agg(F.count("*").alias("test_rows"), F.count_if(F.col("Target") != 0).alias("directional_rows"), F.min("ts").alias("test_from"), F.max("ts").alias("test_to"))
    trained = cuts.where("role = 'train'").groupBy("fold").agg(F.count("*").alias("train_times"))
    return rows.join(trained, "fold", "left").join(classification(own, ["fold"]), "fold", "left")


def refit_all(frame: DataFrame, columns: list[str], rounds: int, trees: Trees = Trees(), weights: Weights = Weights()) -> Model:
    """The production model on all directional rows, with its bounds."""
    rows = cut(sample_weights(directional(frame), weights).withColumn("fold", F.lit(0)))
    models, _ = fit_folds(rows, columns, trees, validated=False, rounds=rounds)
    if not models:
        raise ValueError("rows of one direction only")
    return models[0]
