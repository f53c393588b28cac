"""Gradient-boosted trees for two classes: histograms over a binned column store, leaves grown best first.

Rows become blocks of one byte a value, bin 0 for missing ones, which stay in memory and in the shared folder. A round grows one tree of every
fit (fold) at once: for each level of the trees one job adds up gradients, hessians and counts of the open nodes by column and bin, task by task, and the
driver picks each node's split. What comes back is bounded by nodes, columns and bins, not by rows. All nodes
down to ``depth`` get their best split, then the best gains are taken first until a tree has ``leaves``; as a node's split does not depend on its
neighbours, that is the tree that growing leaf by leaf gives.

Scores at the last anchor are kept like the blocks; a task adds the trees grown since then. Every ``ANCHOR`` rounds they are written anew, which bounds the
lineage. Rows are sampled by a hash of their key and the round, and gradients are rounded to multiples of ``UNIT``, whose sums are exact; so a model does
not depend on how rows lie in tasks, nor on tasks that ran again.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut_rdd

ANCHOR = 25
#: Sums of fewer than 2^53 units are exact in a double.
UNIT = 2.0**-24
LOSS_UNIT = 2.0**-30
#: Rows of a block whose histograms are made at once.
ROWS_AT_ONCE = 1 << 15
#: What a row is used for.
FIT, EVAL, GAP = 0, 1, 2


@dataclass(frozen=True)
class Trees:
    """Settings; ``patience`` is how many rounds may pass without a smaller loss of the eval rows."""

    rounds: int = 800
    step: float = 0.005
    leaves: int = 15
    depth: int = 5
    least_rows: int = 150
    row_share: float = 0.6
    column_share: float = 0.5
    l1: float = 1.0
    l2: float = 3.0
    least_gain: float = 0.01
    least_hessian: float = 1e-3
    balanced: bool = True
    bins: int = 64
    patience: int = 200
    seed: int = 42
    least_rounds: int = 25
    refit_least: int = 150
    refit_default: int = 250
    rows_a_task: int = 50_000


@dataclass
class Tree:
    """Nodes as arrays; feature is -1 in a leaf, rows with a bin up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def node_of(self, x: np.ndarray, deep: int) -> np.ndarray:
        at, rows = np.zeros(x.shape[1], np.int32), np.arange(x.shape[1])
        for _ in range(deep):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = x[np.where(inner, f, 0), rows]
            go = np.where(b == 0, self.missing_left[at], b <= self.threshold[at])
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return at


@dataclass
class Model:
    """``start`` plus the values of the trees' leaves is the log odds of y = 1."""

    columns: list[str]
    bounds: dict[str, tuple[float, float]]
    edges: list[np.ndarray]
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    depth: int = 5

    def gains(self) -> np.ndarray:
        out = np.zeros(len(self.columns))
        for tree in self.trees:
            np.add.at(out, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return out


@dataclass
class Block:
    """Rows of one fit in one task: bins by column and row, class, weight, key and use."""

    fit: int
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    use: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits well mixed (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_rows(key: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    salt = mixed(np.array([seed * 1_000_003 + round_ + 1], np.uint64))
    return (mixed(key + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def sampled_columns(n: int, seed: int, round_: int, share: float) -> np.ndarray:
    """Places of the columns of a round, in order: the nearest whole number of them, one at least."""
    return np.sort(np.random.default_rng([seed, round_]).permutation(n)[: max(1, int(n * share + 0.5))])


def binned(columns: list[np.ndarray], model: Model) -> np.ndarray:
    """One byte a value: 0 for missing, else 1 and the number of edges below the clipped value."""
    out = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
    for k, (name, x) in enumerate(zip(model.columns, columns, strict=True)):
        there = ~np.isnan(x)
        low, high = model.bounds.get(name, (-np.inf, np.inf))
        out[k, there] = 1 + np.searchsorted(model.edges[k], np.clip(x[there], low, high))
    return out


def edges_of(rows: DataFrame, columns: list[str], bounds: dict, bins: int, by: str) -> dict[int, list[np.ndarray]]:
    """Edges of at most ``bins`` - 1 bins for each group of ``by``: quantiles of the clipped columns, all in one aggregate."""
    shares = [float(p) for p in np.arange(1, bins - 1) / (bins - 1)]
    # NaN is the largest double for Spark: as missing values it must not be an edge
    made = rows.groupBy(by).agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), shares, 10_000).alias(f"e{k}") for k, c in enumerate(columns)])
    out = {}
    for r in made.collect():  # a row a group
        own = []
        for k, c in enumerate(columns):
            low, high = bounds.get((r[by], c), (-np.inf, np.inf))
            own.append(np.unique(np.clip(np.array(r[f"e{k}"] or [], float), low, high)))
        out[r[by]] = own
    return out


def blocks_of(rows: DataFrame, models: dict[int, Model], settings: Trees) -> RDD:
    """One list of ``Block`` a partition, of rows (fit, key, y, weight, use, columns)."""
    spark, columns = rows.sparkSession, next(iter(models.values())).columns
    parts = max(1, -(-rows.count() // settings.rows_a_task))
    held = spark.sparkContext.broadcast(models)
    first = ["fit", "key", "y", "weight", "use"]
    # names of their own for the columns, so that none clashes with these
    dealt = rows.select(*first, *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).repartition(parts, "key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[Block]] = {}
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for fit in np.unique(values[0]):
                own = values[0] == fit
                x = binned([v[own].astype(float) for v in values[5:]], held.value[int(fit)])
                out.setdefault(int(fit), []).append(Block(int(fit), x, values[2][own].astype(float), values[3][own].astype(float), values[1][own].astype(np.int64).view(np.uint64), values[4][own].astype(np.int8)))
        whole = [Block(fit, np.concatenate([b.x for b in bs], axis=1), *[np.concatenate([getattr(b, n) for b in bs]) for n in ("y", "w", "key", "use")]) for fit, bs in sorted(out.items())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(whole)], pa.binary())], ["blocks"])

    return cut_rdd(dealt.mapInArrow(make, "blocks binary").rdd.map(lambda r: pickle.loads(r["blocks"])), spark)


def added(a: dict, b: dict) -> dict:
    """Sums by fit."""
    for fit, parts in b.items():
        a[fit] = [x + y for x, y in zip(a[fit], parts, strict=True)] if fit in a else parts
    return a


def summed(rdd: RDD) -> dict:
    return rdd.treeReduce(added, 2) if rdd.getNumPartitions() > 1 else added({}, rdd.first())


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def worth(g: np.ndarray, h: np.ndarray, s: Trees) -> np.ndarray:
    return soft(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-300)


def best_split(hist: np.ndarray, total: np.ndarray, columns: np.ndarray, s: Trees):
    """(gain, feature, threshold, missing left, sums of the left child) or None; hist: columns x bins x (g, h, n). Of equal gains the first column, missing to the right, the lowest threshold."""
    right_missing = np.cumsum(hist[:, 1:-1], axis=1)
    left = np.stack([right_missing, right_missing + hist[:, :1]], axis=1)  # columns x option x thresholds x 3
    right = total - left
    gain = worth(left[..., 0], left[..., 1], s) + worth(right[..., 0], right[..., 1], s) - worth(total[0], total[1], s)
    allowed = (left[..., 2] >= s.least_rows) & (right[..., 2] >= s.least_rows) & (left[..., 1] >= s.least_hessian) & (right[..., 1] >= s.least_hessian)
    allowed[:, 1] &= (hist[:, :1, 2] > 0)  # without missing rows there is one option
    gain = np.where(allowed & (gain > s.least_gain), gain, -np.inf)
    k = int(np.argmax(gain))
    if not np.isfinite(gain.flat[k]):
        return None
    c, option, t = np.unravel_index(k, gain.shape)
    return float(gain.flat[k]), int(columns[c]), int(t) + 1, bool(option), left[c, option, t]


class Growing:
    """A tree while its levels are open: every node's sums and best split."""

    def __init__(self, total: np.ndarray):
        self.sums, self.split, self.kids, self.open = [total], [None], [(-1, -1)], [0]

    def shape(self) -> Tree:
        """All splits so far, to find rows' nodes."""
        return arrays([(s[1], s[2], s[3], *k, 0.0, s[0]) if s else (-1, 0, False, -1, -1, 0.0, 0.0) for s, k in zip(self.split, self.kids, strict=True)])

    def take(self, hists: np.ndarray, columns: np.ndarray, s: Trees, deeper: bool) -> None:
        """Splits the open nodes by their histograms; children that may be split further are open then, unless this was the last level."""
        nodes, self.open = self.open, []
        for node, hist in zip(nodes, hists, strict=True):
            split = best_split(hist, self.sums[node], columns, s)
            if split is None:
                continue
            self.split[node], self.kids[node] = split, (len(self.sums), len(self.sums) + 1)
            for sums in (split[4], self.sums[node] - split[4]):
                if deeper and sums[2] >= 2 * s.least_rows:
                    self.open.append(len(self.sums))
                self.sums.append(sums)
                self.split.append(None)
                self.kids.append((-1, -1))

    def finished(self, s: Trees) -> Tree:
        """The best gains first until there are enough leaves; of equal ones the node found first."""
        taken, queue = set(), [(-self.split[0][0], 0)] if self.split[0] else []
        while queue and len(taken) + 1 < s.leaves:
            _, node = heapq.heappop(queue)
            taken.add(node)
            for kid in self.kids[node]:
                if self.split[kid]:
                    heapq.heappush(queue, (-self.split[kid][0], kid))
        out, places, order = [], {0: 0}, [0]
        for node in order:
            if node in taken:
                for kid in self.kids[node]:
                    places[kid] = len(order)
                    order.append(kid)
        for node in order:
            g, h, _ = self.sums[node]
            value = -float(soft(np.float64(g), s.l1)) / max(h + s.l2, 1e-300) * s.step
            if node in taken:
                gain, f, t, missing, _ = self.split[node]
                out.append((f, t, missing, places[self.kids[node][0]], places[self.kids[node][1]], value, gain))
            else:
                out.append((-1, 0, False, -1, -1, value, 0.0))
        return arrays(out)


def arrays(nodes: list[tuple]) -> Tree:
    kinds = (np.int32, np.int32, bool, np.int32, np.int32, np.float64, np.float64)
    return Tree(*[np.array(x, k) for x, k in zip(zip(*nodes, strict=True), kinds, strict=True)])


def rounded(x: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(x / unit) * unit


def advanced(block: Block, score: np.ndarray, trees: Iterable[Tree], depth: int) -> np.ndarray:
    """Scores with the values of trees added, in order."""
    for tree in trees:
        score = score + tree.value[tree.node_of(block.x, depth)]
    return score


@dataclass
class Pass:
    """What a level of one fit needs: trees since the anchor, the growing tree, its open nodes, and the rows' and columns' samples."""

    since: list[Tree]
    tree: Tree | None
    nodes: list[int]
    columns: np.ndarray
    round_: int
    seed: int
    factors: tuple[float, float]
    uses: tuple[int, ...]


def sums_of(block: Block, score: np.ndarray, p: Pass, s: Trees) -> list:
    """[histograms of the open nodes (or of the whole, without columns), loss of the eval rows, their number]."""
    score = advanced(block, score, p.since, s.depth)
    loss = np.zeros(2)
    if p.tree is None and (later := block.use == EVAL).any():
        z, y = score[later], block.y[later]
        loss[:] = rounded(np.logaddexp(0.0, z) - y * z, LOSS_UNIT).sum(), later.sum()
    bag = np.isin(block.use, p.uses) & sampled_rows(block.key, p.seed, p.round_, s.row_share)
    x, y, w, score = block.x[:, bag], block.y[bag], block.w[bag], score[bag]
    w = w * np.where(y > 0, p.factors[1], p.factors[0])
    prob = 1.0 / (1.0 + np.exp(-score))
    g, h = rounded(w * (prob - y), UNIT), rounded(w * prob * (1.0 - prob), UNIT)
    slots = np.full(max(p.nodes, default=0) + 1 if p.tree is None else len(p.tree.feature), -1, np.int64)
    slots[p.nodes] = np.arange(len(p.nodes))
    at = slots[np.zeros(len(y), np.int64) if p.tree is None else p.tree.node_of(x, s.depth)]
    shape, n = (len(p.nodes), len(p.columns), s.bins, 3), len(p.columns)
    out = np.zeros(shape)
    base = (np.arange(n) * s.bins)[:, None]
    for lo in range(0, len(y), ROWS_AT_ONCE):
        own = np.flatnonzero(at[lo : lo + ROWS_AT_ONCE] >= 0) + lo
        cell = (at[own] * (n * s.bins))[None, :] + base + x[p.columns][:, own]
        for k, v in enumerate((g[own], h[own], None)):
            weights = None if v is None else np.broadcast_to(v, cell.shape).ravel()
            out[..., k] += np.bincount(cell.ravel(), weights, minlength=out[..., k].size).reshape(shape[:3])
    return [out, loss]


def boost(blocks: RDD, models: dict[int, Model], s: Trees, rounds: int, validated: bool, seeds: dict[int, int]) -> dict[int, Model]:
    """The models with their trees, all grown side by side, a job a level.

    Validated, the FIT rows are learned from and a fit ends when ``patience`` rounds passed without a smaller mean loss of its EVAL rows; it
    keeps the trees up to its best round. Else all rows are learned from. A round whose rows allow no split ends its fit, as none of the tree's leaves would differ.
    """
    uses = (FIT,) if validated else (FIT, EVAL, GAP)
    spark = SparkSession.builder.getOrCreate()

    def weighed(own: list[Block]) -> dict:
        """Rows and weight by class."""
        out = {}
        for b in own:
            used = np.isin(b.use, uses)
            y, w = b.y[used], rounded(b.w[used], UNIT)
            out[b.fit] = [np.array([(y == 0).sum(), (y > 0).sum(), w[y == 0].sum(), w[y > 0].sum()], float)]
        return out

    factors, live = {}, {}
    for fit, ((n0, n1, w0, w1),) in summed(blocks.map(weighed)).items():
        if n0 == 0 or n1 == 0:
            continue
        factors[fit] = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if s.balanced else (1.0, 1.0)
        live[fit] = replace(models[fit], start=float(np.log(w1 * factors[fit][1] / (w0 * factors[fit][0]))), trees=[], losses=[], depth=s.depth)
    made, starts = dict(live), {fit: m.start for fit, m in live.items()}
    rows = blocks.map(lambda own: [(b, np.full(len(b.y), starts[b.fit])) for b in own if b.fit in starts])  # with scores up to the anchor
    anchor, kept = 0, None

    def level(passes: dict[int, Pass]) -> dict:
        return summed(rows.map(lambda own: {b.fit: sums_of(b, z, passes[b.fit], s) for b, z in own if b.fit in passes}))

    for round_ in range(rounds + 1):  # the last one only has the loss after the last tree
        if not live:
            break
        if round_ > anchor and round_ % ANCHOR == 0:
            since = {fit: m.trees[anchor:] for fit, m in live.items()}
            rows = cut_rdd(rows.map(lambda own, since=since: [(b, advanced(b, z, since[b.fit], s.depth)) for b, z in own if b.fit in since]), spark)
            if kept is not None:
                kept.unpersist()
            kept, anchor = rows, round_
        columns = {fit: sampled_columns(len(m.columns), seeds[fit], round_, s.column_share) for fit, m in live.items()}
        own = lambda fit, tree, nodes: Pass(made[fit].trees[anchor:], tree, nodes, columns[fit], round_, seeds[fit], factors[fit], uses)
        growing = {}
        for fit, (hist, loss) in level({fit: own(fit, None, [0]) for fit in live}).items():
            m = live[fit]
            if validated and round_ and loss[1]:
                m.losses.append(float(loss[0] / loss[1]))
                if round_ - best_round(m) >= s.patience:
                    del live[fit]
                    continue
            if round_ == rounds:
                continue
            tree = Growing(hist[0, 0].sum(axis=0))
            tree.take(hist, columns[fit], s, s.depth > 1)
            if tree.split[0] is None:
                del live[fit]
            else:
                growing[fit] = tree
        for deep in range(2, s.depth + 1):
            wide = {fit: t for fit, t in growing.items() if t.open}
            if not wide:
                break
            for fit, (hist, _) in level({fit: own(fit, t.shape(), t.open) for fit, t in wide.items()}).items():
                growing[fit].take(hist, columns[fit], s, deep < s.depth)
        for fit, t in growing.items():
            live[fit].trees.append(t.finished(s))
    if kept is not None:
        kept.unpersist()
    for m in made.values():
        if m.losses:
            m.trees = m.trees[: best_round(m)]
    return made


def best_round(m: Model) -> int:
    """The first round of the smallest loss."""
    return int(np.argmin(m.losses)) + 1


def probabilities(rows: DataFrame, models: dict[int, Model], fit: str, kept: list[str]) -> DataFrame:
    """(kept, p_short, p_long) of rows whose column ``fit`` names a model; models are a few megabytes, bounded by rounds and leaves."""
    columns = next(iter(models.values())).columns
    held = rows.sparkSession.sparkContext.broadcast(models)
    source = rows.select(*kept, F.col(fit).alias("__fit"), *[F.col(f"`{c}`").cast("double").alias(f"__c{k}") for k, c in enumerate(columns)])
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("p_short", T.DoubleType()), T.StructField("p_long", T.DoubleType())])
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]]
            p = np.zeros(batch.num_rows)
            for k in np.unique(values[0]):
                own, m = values[0] == k, held.value[int(k)]
                x = binned([v[own].astype(float) for v in values[1:]], m)
                block = Block(int(k), x, *[np.zeros(0)] * 4)
                p[own] = 1.0 / (1.0 + np.exp(-advanced(block, np.full(x.shape[1], m.start), m.trees, m.depth)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(1.0 - p), pa.array(p)], schema.names)

    return source.mapInArrow(run, schema)
