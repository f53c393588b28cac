"""Exact quantiles of many columns by histogram refinement.

A quantile needs one or two order statistics. Each pass counts the values of a range in equal cells, with the smallest and largest value of
each cell; running counts name the cell that a place falls into, and the next pass looks at that cell's range only. A place is found
when its cell holds one value. Cells are counted with map-side combination, so a task holds ``CELLS`` counts a range, however
many values there are; the driver holds the ranges, at most two for a probability, column and group. The cells' ends are values that
occur, so each pass takes at least an end off a range and rounding never moves a value to another cell.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: str | None = None, cells: int = CELLS) -> dict:
    """{(group, column): [quantile, ...]} with linear interpolation between neighbours; columns without values have no entry.

    Nulls and NaN do not count; infinities are values, and a quantile that lies between two of them is one of them. ``by`` names a column of
    groups, of which there are few (its values must not be null); without it the group is None.
    """
    group = F.col(by) if by else F.lit(0)
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)]))
    long = df.select(group.alias("group"), value.alias("v")).select("group", "v.column", "v.x").where("x IS NOT NULL AND NOT isnan(x)")
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    totals = long.groupBy("group", "column").agg(F.count("*").alias("n"), F.count_if(F.col("x") == float("-inf")).alias("low"), F.count(finite).alias("mid"), F.min(finite).alias("a"), F.max(finite).alias("b")).collect()  # a row for each group and column
    sizes, found, open_ = {}, {}, {}
    for r in totals:
        key = (r["group"], r["column"])
        sizes[key] = r["n"]
        for p in probabilities:
            at = p * (r["n"] - 1)
            for k in {math.floor(at), math.ceil(at)}:
                if k < r["low"]:
                    found[*key, k] = float("-inf")
                elif k >= r["low"] + r["mid"]:
                    found[*key, k] = float("inf")
                elif r["a"] == r["b"]:
                    found[*key, k] = r["a"]
                else:
                    open_[*key, k] = (r["a"], r["b"], k - r["low"])  # range, and place in it
    long = long.where(F.abs("x") < float("inf"))
    while open_:
        ranges = [(g, c, a, b) for g, c, a, b in sorted({(g, c, a, b) for (g, c, _), (a, b, _) in open_.items()}, key=repr)]
        kind = dict(long.dtypes)["group"]
        within = df.sparkSession.createDataFrame(ranges, f"group {kind}, column int, a double, b double")
        own = long.join(F.broadcast(within), ["group", "column"]).where("x BETWEEN a AND b")  # as many rows as the driver holds
        # halves, so that a range over nearly all doubles has a finite width
        cell = F.least(F.floor((F.col("x") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * cells), F.lit(cells - 1))
        cell = F.when(F.col("x") == F.col("b"), cells).otherwise(F.coalesce(cell, F.lit(0))).alias("cell")
        counted = own.groupBy("group", "column", "a", "b", cell).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.sum("n").over(Window.partitionBy("group", "column", "a", "b").orderBy("cell")) - F.col("n")
        places = df.sparkSession.createDataFrame([(g, c, a, b, k, at) for (g, c, k), (a, b, at) in open_.items()], f"group {kind}, column int, a double, b double, k long, at long")
        hit = counted.withColumn("before", before).join(F.broadcast(places), ["group", "column", "a", "b"]).where("at >= before AND at < before + n")
        for r in hit.collect():  # a row for each place
            key = (r["group"], r["column"], r["k"])
            if r["low"] == r["high"]:
                found[key] = r["low"]
                del open_[key]
            else:
                open_[key] = (r["low"], r["high"], r["at"] - r["before"])
    out = {}
    for (g, c), n in sizes.items():
        values = []
        for p in probabilities:
            at = p * (n - 1)
            low, high, share = found[g, c, math.floor(at)], found[g, c, math.ceil(at)], at - math.floor(at)
            values.append(low if low == high or share == 0 else high if math.isinf(high) else low if math.isinf(low) else low + (high - low) * share)
        out[g if by else None, columns[c]] = values
    return out
