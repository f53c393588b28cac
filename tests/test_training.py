import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features as fx
from tidemark.operators import boosting, quantiles, training
from tidemark.plans import catalogue

HOUR = 3_600_000


def test_walk_forward(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        for s in "ab":
            x = rng.normal()
            rows.append((s, i * HOUR, x, rng.normal(), int(np.sign(x) * (rng.uniform() < 0.8))))
    frame = spark.createDataFrame([(s, t, float(x), float(z), y) for s, t, x, z, y in rows], "symbol string, ts long, x double, z double, Target int")
    assert training.feature_columns(frame) == ["x", "z"] and training.feature_columns(frame, ("z",)) == ["x"]
    trees = training.Trees(rounds=3, step=0.3, depth=2, least_rounds=1, least_rows=5)
    found, gains = training.walk_forward(frame, ["x", "z"], folds=2, gap=5, trees=trees)
    got = found.toPandas()
    assert len(got) == 2 * 80 * 2 and set(got.fold) == {1, 2}  # every test row, also those without direction
    moved = got[got.Target != 0]
    assert ((moved.p_long > 0.5) == (moved.Target == 1)).mean() > 0.9
    assert np.allclose(got.p_long + got.p_short, 1)
    top = gains.orderBy("gain", ascending=False).first()
    assert top["feature"] == "x"
    with pytest.raises(ValueError):
        training.directional(frame.selectExpr("symbol", "ts", "5 AS Target"))


def test_registered_walk_forward_is_the_whole_job(spark, monkeypatch):
    seen = {}

    def record(frame, columns, *args, **options):
        seen.update(frame=frame, columns=columns, args=args, options=options)
        return frame, None

    monkeypatch.setattr(training, "walk_forward", record)
    catalogue.walk_forward_model(spark, "/root/testdata/sf0.01")
    assert set(fx.NAMES) <= set(seen["columns"]) and (seen["args"], seen["options"]) == ((), {})
    assert not seen["frame"].isEmpty()


def fold_rows(n=700, seed=4):
    """Rows (fold, symbol, ts, y, weight, three columns) of two folds: missing values, few different values, a column that decides."""
    rng = np.random.default_rng(seed)
    rows = []
    for fold in (1, 2):
        for i in range(n // fold):
            a, b, c = rng.normal(), float(rng.integers(0, 5)), rng.normal()
            y = float((a + 0.3 * b * (c > 0) + rng.normal() > 0.4))
            rows.append((fold, "xy"[i % 2], i // 2 * HOUR, y, float(rng.uniform(0.8, 1.35)), None if i % 11 == 0 else a, b, float("nan") if i % 7 == 0 else c))
    return rows


COLUMNS = ["a", "b", "c"]
FOLD_ROWS = "fold int, symbol string, ts long, y double, weight double, a double, b double, c double"


def plain_boost(x, edges, y, w, key, fit_rows, eval_rows, s, seed, rounds):
    """The algorithm on whole arrays, leaf by leaf: ([(tree as nested tuples)], [losses])."""
    bins = np.zeros(x.shape, int)
    for j in range(x.shape[1]):
        for i in range(len(x)):
            bins[i, j] = 0 if np.isnan(x[i, j]) else 1 + sum(e < x[i, j] for e in edges[j])
    n = fit_rows.sum()
    factor = np.where(y > 0, n / (2 * (y[fit_rows] > 0).sum()), n / (2 * (y[fit_rows] == 0).sum()))
    unit = 2.0**-24
    even = np.rint(w / unit) * unit * factor
    score = np.full(len(y), np.log(even[fit_rows & (y > 0)].sum() / even[fit_rows & (y == 0)].sum()))
    soft = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    worth = lambda g, h: soft(g) ** 2 / (h + s.l2)
    trees, losses = [], []
    for r in range(rounds):
        bag = fit_rows & boosting.sampled_rows(key, seed, r, s.row_share)
        columns = boosting.sampled_columns(x.shape[1], seed, r, s.column_share)
        p = 1 / (1 + np.exp(-score))
        g, h = np.rint(w * factor * (p - y) / unit) * unit, np.rint(w * factor * p * (1 - p) / unit) * unit

        def best(rows):
            out, total = None, (g[rows & bag].sum(), h[rows & bag].sum())
            for j in columns:
                for missing_left in (False, True) if (rows & bag & (bins[:, j] == 0)).any() else (False,):
                    for t in range(1, s.bins - 1):
                        left = rows & np.where(bins[:, j] == 0, missing_left, bins[:, j] <= t)
                        a, b = left & bag, rows & ~left & bag
                        if min(a.sum(), b.sum()) < s.least_rows or min(h[a].sum(), h[b].sum()) < s.least_hessian:
                            continue
                        gain = worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum()) - worth(*total)
                        if gain > s.least_gain and (out is None or gain > out[0] + 1e-12):
                            out = (gain, int(j), t, missing_left, left)
            return out

        leaves = [{"rows": np.ones(len(y), bool), "deep": 0}]
        leaves[0]["split"] = best(leaves[0]["rows"])
        if leaves[0]["split"] is None:
            break
        splits = []
        while len(leaves) < s.leaves and (able := [k for k in leaves if k["split"]]):
            top = max(able, key=lambda k: k["split"][0])
            gain, j, t, missing_left, left = top["split"]
            splits.append((j, t, missing_left, round(gain, 9)))
            leaves = [k for k in leaves if k is not top]
            for rows in (left, top["rows"] & ~left):
                deep = top["deep"] + 1
                leaves.append({"rows": rows, "deep": deep, "split": best(rows) if deep < s.depth else None})
        for k in leaves:
            own = k["rows"] & bag
            score = score + np.where(k["rows"], -soft(g[own].sum()) / (h[own].sum() + s.l2) * s.step, 0)
        trees.append(sorted(splits))
        if eval_rows.any():
            losses.append(np.mean(np.logaddexp(0, score[eval_rows]) - y[eval_rows] * score[eval_rows]))
    return trees, losses


@pytest.mark.parametrize(("anchor", "rows_a_task"), [(3, 150), (25, 10**6)])
def test_trees_are_those_of_the_plain_algorithm(spark, monkeypatch, anchor, rows_a_task):
    monkeypatch.setattr(boosting, "ANCHOR", anchor)
    s = training.Trees(rounds=8, step=0.3, leaves=6, depth=3, least_rows=12, row_share=0.7, column_share=0.67, bins=16, patience=100, least_rounds=1, rows_a_task=rows_a_task)
    df = spark.createDataFrame(fold_rows(), FOLD_ROWS).withColumn("key", F.xxhash64("symbol", "ts"))
    used = training.used_rows(df, 10).cache()
    bounds = {k: tuple(v) for k, v in training.exact_quantiles(df, COLUMNS, [0.01, 0.99], "fold").items()}
    edges = boosting.edges_of(df, COLUMNS, bounds, s.bins, "fold")
    models, rounds = training.fit_folds(df.drop("key"), COLUMNS, s, 10)
    assert set(models) == {1, 2} and rounds == {k: len(m.trees) for k, m in models.items()}
    rows = used.toPandas()
    for fold, m in models.items():
        own = rows[rows.fold == fold].sort_values(["ts", "symbol"])
        x = np.column_stack([np.clip(own[c].to_numpy(float), *bounds[fold, c]) for c in COLUMNS])
        args = (x, edges[fold], own.y.to_numpy(), own.weight.to_numpy(), own.key.to_numpy().view(np.uint64), (own.use == boosting.FIT).to_numpy(), (own.use == boosting.EVAL).to_numpy())
        trees, losses = plain_boost(*args, s, s.seed + fold, s.rounds)
        best = int(np.argmin(losses)) + 1
        assert np.allclose(m.losses, losses, atol=1e-6) and len(m.trees) == best
        got = [sorted((int(f), int(t), bool(left), round(float(g), 9)) for f, t, left, g in zip(k.feature, k.threshold, k.missing_left, k.gain, strict=True) if f >= 0) for k in m.trees]
        assert [[x[:3] for x in k] for k in got] == [[x[:3] for x in k] for k in trees[:best]]
        assert np.allclose([x[3] for k in got for x in k], [x[3] for k in trees[:best] for x in k])
        assert all((k.feature >= 0).sum() < s.leaves for k in m.trees)
    scored = training.predict(models, df).toPandas()
    y = scored.y.to_numpy()
    assert len(scored) == len(rows) and ((scored.p_long > 0.5) == (y > 0.5)).mean() > 0.7 and np.allclose(scored.p_long + scored.p_short, 1)


def test_patience_and_refits(spark):
    """Noise has its best round early: a fit stops ``patience`` rounds later, and a fold below ``least_rounds`` is grown anew on all rows."""
    rng = np.random.default_rng(0)
    rows = [(f, "x", i * HOUR, float(rng.integers(0, 2)), 1.0, rng.normal(), rng.normal(), rng.normal()) for f in (1, 2) for i in range(160)]
    df = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows], FOLD_ROWS)
    s = training.Trees(rounds=60, step=0.5, depth=2, least_rows=3, l1=0.0, l2=0.1, least_gain=0.0, patience=4, least_rounds=30, refit_least=5, refit_default=9)
    models, rounds = training.fit_folds(df, COLUMNS, s)
    for m in models.values():
        assert len(m.losses) == boosting.best_round(m) + s.patience < s.rounds
    assert rounds == {1: 9, 2: 9}  # the first has the default, the next the median of those before
    assert [len(m.trees) for m in models.values()] == [9, 9]
    one = training.refit_all(df.where("fold = 1").drop("fold", "y", "weight").withColumn("Target", F.when(F.col("a") > 0, 1).otherwise(-1)), COLUMNS, 4, s)
    assert len(one.trees) == 4 and one.gains()[0] > one.gains()[1:].sum()


def test_walk_forward_without_directions(spark):
    """A fold of one direction has no rows; without any other, both results are empty."""
    frame = spark.createDataFrame([("s", i * HOUR, float(i), 1) for i in range(60)], "symbol string, ts long, x double, Target int")
    found, gains = training.walk_forward(frame, ["x"], folds=2, gap=1)
    assert found.count() == 0 == gains.count() and found.columns == ["symbol", "ts", "Target", "p_short", "p_long", "fold"]
    empty, _ = training.walk_forward(frame.limit(0), ["x"], folds=2, gap=1)
    assert empty.count() == 0


@pytest.mark.parametrize("cells", [2, 7, 1024])
def test_exact_quantiles(spark, cells):
    rng = np.random.default_rng(cells)
    big = np.concatenate([rng.normal(size=300), [1e300, -1e300, 1e-300, 5e-324, 0.0, -0.0, 1.7e308, -1.7e308]])
    columns = {"normal": rng.normal(size=308), "ties": rng.integers(0, 3, 308).astype(float), "wide": big, "one": np.full(308, 7.5), "near": 1 + rng.integers(0, 40, 308) * 2.0**-52, "skewed": np.exp(rng.normal(size=308) * 20)}
    if cells == 2:  # two cells halve a range, which is slow over all doubles
        columns.pop("wide")
    p = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    rows = [tuple(float(v[i]) for v in columns.values()) + (i % 3, None, float("nan") if i % 2 else float(i)) for i in range(308)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", g int, nothing double, some double")
    found = quantiles.exact_quantiles(df, [*columns, "nothing", "some"], p, cells=cells)
    assert (None, "nothing") not in found
    for c, v in columns.items():
        assert np.allclose(found[None, c], np.quantile(v, p), rtol=1e-12, atol=0), c
    assert np.allclose(found[None, "some"], np.quantile(np.arange(0, 308, 2), p))
    if cells == 1024:
        grouped = quantiles.exact_quantiles(df, ["normal", "ties"], p, "g")
        for g in range(3):
            assert np.allclose(grouped[g, "normal"], np.quantile(columns["normal"][g::3], p), rtol=1e-12)
        ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
        assert quantiles.exact_quantiles(ends, ["x"], [0.0, 0.2, 0.5, 1.0]) == {(None, "x"): [float("-inf"), float("-inf"), 1.5, float("inf")]}
        assert quantiles.exact_quantiles(df.limit(0), ["normal"], p) == {}
