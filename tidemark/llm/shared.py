"""Lineage cuts, size-checked broadcasts and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); only where that is unset and Spark runs in one process, as in tests, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = path or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="tidemark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that a lost executor costs no recomputation of what stands before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df (already cut) has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def side_of_ids(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids (cut) as the right side of a semi or anti join against documents: broadcast up to ``most`` rows (8 MB of longs), else joined by shuffle."""
    return F.broadcast(ids) if small_enough(ids, most) else ids


#: Edges that one task contracts at a time, about (16 bytes each, and some working arrays).
PART_EDGES = 400_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these edges lead to) for every node but the smallest ones."""
    nodes = np.unique(np.concatenate([a, b]))
    a, b, label = np.searchsorted(nodes, a), np.searchsorted(nodes, b), np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, higher := label[label]):
            label = higher
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars, some ``PART_EDGES`` at a time together with the stars before."""
    a = b = np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []
    for last in (False, True):
        for batch in () if last else batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= PART_EDGES:
                a, b = contracted(*(np.concatenate([s, *(x.column(i).to_numpy() for x in held)]) for i, s in enumerate((a, b))))
                held = []
                if len(a) >= PART_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a = b = np.zeros(0, np.int64)
    if held:
        a, b = contracted(*(np.concatenate([s, *(x.column(i).to_numpy() for x in held)]) for i, s in enumerate((a, b))))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a long, b long); component is the smallest node that is reachable.

    Tasks contract their own edges to stars first, some ``PART_EDGES`` at a time. Where that took more than one task,
    large-star and small-star steps alternate until nothing changes. A round sends each edge to its ends' minimum after
    partial aggregation, so a node with very many edges is no single group, and nothing is collected. Loops and null
    ends count for nothing; repeated edges count once.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    parts = max(1, -(-now.count() // PART_EDGES))
    now = cut(now.coalesce(parts).mapInArrow(contract, "a long, b long"))
    if parts > 1:
        now = stars(now, rounds)
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def stars(now: DataFrame, rounds: int) -> DataFrame:
    """Edges (a, b) with a > b as stars around the smallest node of each component."""
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        now = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(small.select("a", F.col("m").alias("b")))
        now = cut(now.distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == mark:
            return now
        before = mark
    raise RuntimeError("components did not settle")
