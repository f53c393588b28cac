"""Walk-forward folds, purging, winsorising and sample weights."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

DAY_MS = 86_400_000


def timeline(frame: DataFrame) -> DataFrame:
    """(ts, i): the distinct times in order, from 0. One row a bar time, so the single ordered pass is short whatever the symbols."""
    return frame.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)


def numbered(frame: DataFrame, name: str, *by: str) -> DataFrame:
    """frame with each row's place by (ts, symbol), from 1, in groups of ``by``. Only the row counts of the times pass through one task; a time's own rows are numbered apart."""
    counts = frame.groupBy(*[F.col(c).alias(f"__{c}") for c in by], F.col("ts").alias("__ts")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__ts").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    own = frame.withColumn(name, F.row_number().over(Window.partitionBy(*by, "ts").orderBy("symbol")))
    same = F.col("ts").eqNullSafe(F.col("__ts"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return own.join(before, same).withColumn(name, F.col(name) + F.col("__before")).drop("__ts", "__before", *[f"__{c}" for c in by])


def expanding_folds(frame: DataFrame, folds: int = 5, gap: int = 20) -> DataFrame:
    """(fold, ts, role): times cut into folds + 1 stretches; each of the last is tested on all that stands before, less the last gap times (kept if there are no more than gap)."""
    line = timeline(frame)
    sized = line.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("size", F.floor(F.col("n") / (folds + 1)))
    each = sized.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("start", F.col("n") - (folds - F.col("fold") + 1) * F.col("size"))
    purge = F.when(F.col("start") > gap, gap).otherwise(0)
    role = F.when((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + F.col("size")), "test").when(F.col("i") < F.col("start") - purge, "train")
    return each.select("fold", "ts", role.alias("role")).where("role is not null")


def month_folds(frame: DataFrame, train_months: int, test_months: int = 1, expanding: bool = True, gap: int = 0) -> DataFrame:
    """(fold, ts, role) by calendar months from the first time on; folds without train or test rows are left out and not numbered."""
    line = timeline(frame).withColumn("at", F.timestamp_millis("ts").cast("timestamp_ntz"))
    ends = line.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    if ends["a"] is None:
        return line.select(F.lit(1).alias("fold"), "ts", F.lit("train").alias("role")).limit(0)
    cuts, start, fold = [], add_months(ends["a"], train_months), 0
    while start <= ends["b"]:
        fold, stop = fold + 1, add_months(start, test_months)
        cuts.append((fold, None if expanding else add_months(start, -train_months), start, stop))
        start = stop
    if not cuts:
        return line.select(F.lit(1).alias("fold"), "ts", F.lit("train").alias("role")).limit(0)
    bounds = frame.sparkSession.createDataFrame(cuts, "fold int, since timestamp_ntz, start timestamp_ntz, stop timestamp_ntz")
    rows = line.join(F.broadcast(bounds), (F.col("at") < F.col("stop")) & (F.col("since").isNull() | (F.col("at") >= F.col("since"))))  # a row a fold
    rows = rows.withColumn("role", F.when(F.col("at") >= F.col("start"), "test").otherwise("train"))
    place = F.row_number().over(Window.partitionBy("fold", "role").orderBy(F.desc("ts")))
    train_size = F.count_if(F.col("role") == "train").over(Window.partitionBy("fold"))
    rows = rows.withColumn("place", place).withColumn("size", train_size).where((F.col("role") == "test") | (F.col("size") <= gap) | (F.col("place") > gap))
    full = F.collect_set("role").over(Window.partitionBy("fold"))
    rows = rows.withColumn("both", F.size(full)).where("both = 2")
    return rows.select(F.dense_rank().over(Window.orderBy("fold")).alias("fold"), "ts", "role")


def add_months(at: datetime, months: int) -> datetime:
    """Calendar months; the day is clamped to the month's last."""
    k = at.year * 12 + at.month - 1 + months
    year, month = divmod(k, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - datetime(year, month + 1, 1)).days
    return at.replace(year=year, month=month + 1, day=min(at.day, last))


def clip_bounds(train: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> dict[str, tuple[float, float]]:
    """Exact quantiles of each column; the bounds are two numbers a column."""
    return {c: tuple(v) for (_, c), v in exact_quantiles(train, columns, [low, high]).items()}


def clipped(frame: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns within their bounds; NULL stays NULL."""
    return frame.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))) for c, (a, b) in bounds.items()})


@dataclass(frozen=True)
class Weights:
    half_life_days: float = 180.0
    recent_days: float = 60.0
    recent_boost: float = 1.5
    slope_scale: float = 0.08
    strength: float = 0.18
    strength_cap: float = 0.25
    least: float = 0.8
    most: float = 1.35


def sample_weights(frame: DataFrame, w: Weights = Weights(), by: str | None = None) -> DataFrame:
    """frame with weight: exponential decay from the last time (of its group ``by``, of which there are few), a boost for recent rows and for clear market regimes."""
    columns = frame.columns
    if by is None:
        last = F.lit(frame.agg(F.max("ts").alias("t")).first()["t"])
    else:
        frame = frame.join(F.broadcast(frame.groupBy(by).agg(F.max("ts").alias("__last"))), by)  # a row a group
        last = F.col("__last")
    days = (last - F.col("ts")) / float(DAY_MS)
    weight = F.exp(-F.log(F.lit(2.0)) / w.half_life_days * days) * F.when(days <= w.recent_days, w.recent_boost).otherwise(1.0)
    terms = []
    for c in ("market_breadth_ema_fast_slow_1h", "market_breadth_pos_return_4h_3"):
        if c in frame.columns:
            terms.append(F.least(F.abs(F.coalesce(c, F.lit(0.5)) * 2.0 - 1.0), F.lit(1.0)))
    if "ema_slope_4h" in frame.columns and w.slope_scale > 0:
        terms.append(F.tanh(F.abs(F.coalesce("ema_slope_4h", F.lit(0.0))) / w.slope_scale))
    if terms:
        weight = weight * (1.0 + F.greatest(F.lit(0.0), F.least(sum(terms[1:], terms[0]) / float(len(terms)) * w.strength, F.lit(w.strength_cap))))
    return frame.select(*[f"`{c}`" for c in columns if c != "weight"], F.greatest(F.lit(w.least), F.least(weight, F.lit(max(w.least, w.most)))).alias("weight"))


FRACTIONS = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


def eval_split(train: DataFrame, label: str = "y", fractions: tuple[float, ...] = FRACTIONS, most_gap: float = 0.08) -> dict:
    """The first suffix share whose label rate is within most_gap of the rest's, else the closest."""
    plans = eval_plans(train.select("ts", "symbol", F.col(label).alias("y"), F.lit(0).alias("fold")), fractions, most_gap)
    return plans.get(0) or {"rows": 0, "eval_size": 1, "fit_rate": 0.5, "eval_rate": 0.5, "expanded": False}


def eval_plans(train: DataFrame, fractions: tuple[float, ...] = FRACTIONS, most_gap: float = 0.08) -> dict[int, dict]:
    """``eval_split`` of every fold of train (fold, ts, symbol, y), with its number of rows; rates come from one pass of conditional sums over row places."""
    sizes = train.groupBy("fold").agg(F.count("*").alias("n"))
    rows = numbered(train.select("fold", "ts", "symbol", "y"), "r", "fold").join(F.broadcast(sizes), "fold")  # a row a fold
    late = {i: F.greatest(F.lit(1), F.least(F.floor(F.col("n") * f), F.col("n") - 1)) for i, f in enumerate(fractions)}
    sums = rows.groupBy("fold").agg(F.first("n").alias("n"), F.sum("y").alias("all"), *[F.sum(F.when(F.col("r") > F.col("n") - s, F.col("y")).otherwise(0)).alias(f"s{i}") for i, s in late.items()])
    return {r["fold"]: chosen(r["n"], r["all"], [r[f"s{i}"] for i in late], fractions, most_gap) for r in sums.collect()}


def chosen(n: int, total: float, late: list[float], fractions: tuple[float, ...], most_gap: float) -> dict:
    """The split of n rows with ``total`` positive ones, of which ``late`` are in the suffixes."""
    sizes = [min(max(1, int(n * f)), n - 1) for f in fractions]
    if n < 2:
        return {"rows": n, "eval_size": 1, "fit_rate": total / n, "eval_rate": total / n, "expanded": False}
    best = None
    for i, s in enumerate(sizes):
        early = total - late[i]
        if late[i] in (0, s) or early in (0, n - s):
            continue
        plan = {"rows": n, "eval_size": s, "fit_rate": early / (n - s), "eval_rate": late[i] / s, "expanded": i > 0}
        plan["rate_gap"] = abs(plan["eval_rate"] - plan["fit_rate"])
        if plan["rate_gap"] <= most_gap:
            return plan
        best = plan if best is None or plan["rate_gap"] < best["rate_gap"] else best
    return best or {"rows": n, "eval_size": sizes[0], "fit_rate": (total - late[0]) / (n - sizes[0]), "eval_rate": late[0] / sizes[0], "expanded": False}
