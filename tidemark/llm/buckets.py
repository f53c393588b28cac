"""Documents dealt by hash into buckets: one shuffle of the texts that several passes read, each bucket one call in Python.

What a pass has to tell the next one goes back to the buckets and not to single documents, so a string, line or key that
very many documents share has one row a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a bucket, about; a longer text makes its own larger.
BUCKET_BYTES = 2_000_000


def texts_of(docs: DataFrame, kept: list[str]) -> DataFrame:
    """(doc_id, h, text, kept): whether the text was null and the columns ``kept``, as a struct that clashes with nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.col("text").isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).alias("kept")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), row)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int").alias("bucket")


def buckets_for(sizes: DataFrame) -> int:
    """How many buckets rows with ``n`` bytes need, and two a core at least if there are as many rows."""
    size = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    least = min(size["rows"], 2 * sizes.sparkSession.sparkContext.defaultParallelism)
    return max(1, -(-(size["n"] or 0) // BUCKET_BYTES), least)


def beside(kind: int, rows: DataFrame, *columns: Column) -> DataFrame:
    """Rows in the shape in which they meet a bucket's documents: (bucket, kind, a, b, c, d)."""
    values = [*columns, *[F.lit(0)] * (4 - len(columns))]
    return rows.select("bucket", F.lit(kind).alias("kind"), *[v.cast("long").alias(n) for v, n in zip(values, "abcd", strict=True)])


def columns_of(right: pa.Table, kind: int) -> list[np.ndarray]:
    own = right.column("kind").to_numpy() == kind
    return [right.column(n).to_numpy()[own] for n in "abcd"]


def spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[f.type]}" for f in schema)
