"""Backward as-of join: each left row meets the latest right row that is not later.

The right rows are laid between the left ones and the last of them is carried forward, a struct at a time, so that the latest row
counts even where its values are NULL. No range join and no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, on: str, columns: list[str], bucket: int | None = None) -> DataFrame:
    """left with right's columns, NULL before the first right row. Exact matches count.

    bucket: width of ``on`` by which a key is split over tasks. Each bucket then carries its own rows, and the last right
    row of the buckets before it comes from a table of one row a bucket.
    """
    names = left.columns
    payload = F.struct(*columns)
    kind = right.select(payload.alias("r")).schema["r"].dataType
    lefts = left.withColumn("__r", F.lit(None).cast(kind)).withColumn("__side", F.lit(1))
    blanks = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names if c not in (by, on)]
    rights = right.select(F.col(by), F.col(on), *blanks, payload.alias("__r"), F.lit(0).alias("__side")).select(*names, "__r", "__side")
    rows = lefts.unionByName(rights)
    keys = [by]
    if bucket:
        rows = rows.withColumn("__bucket", F.floor(F.col(on) / bucket))
        keys.append("__bucket")
    last = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("__last", last).where("__side = 1")
    if bucket:
        ends = right.groupBy(by, F.floor(F.col(on) / bucket).alias("__from")).agg(F.max_by(payload, on).alias("__carry"))
        buckets = found.select(by, "__bucket").distinct()
        marks = buckets.withColumn("__carry", F.lit(None).cast(kind)).withColumn("__mark", F.lit(0)).unionByName(ends.select(by, F.col("__from").alias("__bucket"), "__carry", F.lit(1).alias("__mark")))
        carried = F.last("__carry", ignorenulls=True).over(Window.partitionBy(by).orderBy("__bucket", "__mark").rowsBetween(Window.unboundedPreceding, 0))
        carry = marks.withColumn("__before", carried).where("__mark = 0").select(by, "__bucket", "__before")
        found = found.join(carry, [by, "__bucket"], "left").withColumn("__last", F.coalesce("__last", "__before"))
    return found.select(*names, *[F.col(f"__last.{c}").alias(c) for c in columns])
