"""Substring removal by MinHash over paragraphs.

A paragraph is a line. Lines of more than ``window`` words are also cut into pieces at words chosen by their content (the
smallest hash in every run of ``window`` three-word sequences), so that a passage pasted into the middle of a line falls
into the same pieces everywhere. Pieces are compared whole; lines of ``least_words`` words or more also by similarity:

* ``BANDS`` bands of ``ROWS`` MinHash values over their 5-word shingles: two lines of similarity 0.8 meet in a band with
  probability 1 - (1 - 0.8^3)^7 = 0.993;
* lines that meet in a band, directly or through others, form a block, and inside it exact Jaccard similarity is checked
  on whole shingle sets by tree joins (see jaccard_join), which give the components.

Documents are dealt into buckets (see buckets). A bucket sends one row for each of its different lines and pieces, with its
smallest and largest document; what is repeated goes back to the buckets. Of a component (or of equal pieces) the
paragraphs of the smallest document stay; those of other documents are repeated. Repeated stretches that touch are laid
together, and those of ``least_bytes`` bytes or more are removed; shorter ones are common phrases and stay (1 removes all).

Defined cases: null or empty text has no paragraph; repeats inside one document, or in rows of one id, stay; rows without an
id neither lose nor remove anything; rows that repeat an id are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .buckets import beside, bucket_of, buckets_for, columns_of, spark_schema, texts_of
from .jaccard_join import placed_in_chunks, tree_components
from .shared import connected_components, cut, small_enough

BANDS, ROWS, SHINGLE = 7, 3, 5
#: So many different lines may be looked for through a broadcast of their hashes (8 MB); more are sent by a shuffle.
MOST_BROADCAST = 1_000_000
SPANS_SCHEMA = "doc_id long, spans array<struct<first:long,after:long,component:long>>"
SEEDS = ts.mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64) * ts.BASE)


class Scan:
    """The words, lines and pieces of a slice of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.starts, self.ends, counts = ts.word_spans(data, offsets, ts.NOT_SPACE)
        self.hashes = ts.span_hashes(data, self.starts, self.ends)
        self.rows = np.repeat(np.arange(len(counts)), counts)
        n = len(self.starts)
        new = np.zeros(n + 1, dtype=bool)
        if n:
            breaks = np.flatnonzero(data == 0x0A)
            new[np.searchsorted(self.starts, breaks)] = True
            new[np.concatenate(([0], np.cumsum(counts)))[:-1][counts > 0]] = True
        self.lines = np.flatnonzero(new[:-1])
        self.line_ends = np.append(self.lines[1:], n)[: len(self.lines)]
        if n >= window + 2:
            places = ts.distinct(ts.minimum_places(ts.runs(self.hashes, 3), window))
            new[places] = True
        cuts = np.flatnonzero(new[:-1])
        ends = np.append(cuts[1:], n)[: len(cuts)]
        line = np.searchsorted(self.lines, cuts, side="right") - 1
        inner = (self.line_ends[line] - self.lines[line]) > window if n else np.zeros(0, bool)
        self.pieces, self.piece_ends = cuts[inner], ends[inner]

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines and pieces: row, hash, first byte, byte after the last (both of the slice), first word; in order of place."""
        first, after = np.concatenate([self.lines, self.pieces]), np.concatenate([self.line_ends, self.piece_ends])
        by = np.argsort(first, kind="stable")
        first, after = first[by], after[by]
        return self.rows[first], ts.signed(ts.sequence_hashes(self.hashes, first, after)), self.starts[first], self.ends[after - 1], first

    def bands(self, which: np.ndarray) -> np.ndarray:
        """Band values of the lines ``which``, each with at least SHINGLE words: a row a line."""
        first, size = self.lines[which], (self.line_ends - self.lines)[which] - SHINGLE + 1
        after = np.cumsum(size)
        at = np.arange(after[-1]) + np.repeat(first - (after - size), size)
        own = ts.runs(self.hashes, SHINGLE)[at]
        least = np.stack([np.minimum.reduceat(ts.mix(own ^ seed), after - size) for seed in SEEDS], axis=1).reshape(len(which), BANDS, ROWS)
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(which), BANDS)).copy()
        for r in range(ROWS):
            out = ts.mix(out * ts.BASE + least[:, :, r])
        return out


def line_bands(docs: DataFrame, window: int, least_words: int) -> DataFrame:
    """(band, h, doc_id) of the lines that are compared by similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, offsets in ts.slices(batch.column(1)):
                scan = Scan(data, offsets, window)
                which = np.flatnonzero(scan.line_ends - scan.lines >= least_words)
                if len(which):
                    h = ts.signed(ts.sequence_hashes(scan.hashes, scan.lines[which], scan.line_ends[which]))
                    yield pa.RecordBatch.from_arrays([pa.array(ts.signed(scan.bands(which).ravel())), pa.array(np.repeat(h, BANDS)), pa.array(np.repeat(ids[lo + scan.rows[scan.lines[which]]], BANDS))], ["band", "h", "doc_id"])

    return docs.mapInArrow(run, "band long, h long, doc_id long")


def wanted_lines(docs: DataFrame, window: int) -> DataFrame:
    """(h, tokens): shingle sets of the lines whose hashes are in the row's ``wanted``. docs: (doc_id, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                scan = Scan(data, offsets, window)
                h = ts.signed(ts.sequence_hashes(scan.hashes, scan.lines, scan.line_ends))
                of = scan.rows[scan.lines]
                edges = np.searchsorted(of, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    mine = np.arange(edges[r], edges[r + 1])
                    mine = mine[np.isin(h[mine], batch.column(2)[lo + r].values.to_numpy())]
                    sets = [ts.signed(np.unique(ts.runs(scan.hashes[scan.lines[i] : scan.line_ends[i]], SHINGLE))) for i in mine.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(h[mine]), pa.array(sets, pa.list_(pa.int64()))], ["h", "tokens"])

    return docs.mapInArrow(run, "h long, tokens array<long>")


def line_components(rows: DataFrame, num: int, den: int, window: int, least_words: int, chunk_tokens: int) -> DataFrame:
    """(h, component, low) of lines with similar others, low being the component's smallest document, cut. rows: (doc_id, text)."""
    bands = line_bands(rows, window, least_words).groupBy("band", "h").agg(F.min("doc_id").alias("doc_id"))  # equal lines count once
    by = Window.partitionBy("band")
    met = cut(bands.withColumns({"low": F.min("h").over(by), "high": F.max("h").over(by)}).where("low < high").select("h", "low", "doc_id"))
    blocks = connected_components(met.where("h > low").select(F.col("h").alias("a"), F.col("low").alias("b")))
    holder = cut(met.groupBy("h").agg(F.min("doc_id").alias("doc_id")))
    wanted = holder.groupBy("doc_id").agg(F.collect_list("h").alias("wanted"))
    if small_enough(holder, MOST_BROADCAST):
        wanted = F.broadcast(wanted)
    sets = wanted_lines(rows.join(wanted, "doc_id").select("doc_id", "text", "wanted"), window).dropDuplicates(["h"])
    nodes = sets.join(blocks.select(F.col("node").alias("h"), F.col("component").alias("block")), "h")
    nodes = nodes.select(F.col("h").alias("node"), "block", F.size("tokens").cast("long").alias("n"), "tokens")
    members = cut(placed_in_chunks(nodes, num, den, chunk_tokens).select("node", "block", "chunk", "class", "tokens"))
    found = tree_components(members, num, den)[1].select(F.col("node").alias("h"), "component")
    found = cut(found.join(holder, "h"))
    return cut(found.select("h", "component").join(found.groupBy("component").agg(F.min("doc_id").alias("low")), "component"))


NAMED = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("low", pa.int64()), ("more", pa.int64())])
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("component", pa.int64())]))


def name(table: pa.Table, window: int) -> pa.Table:
    """One row for each different line or piece of a bucket: its hash, smallest document, largest less smallest."""
    ids, found = table.column("doc_id").to_numpy(), []
    for lo, _, data, offsets in ts.slices(table.column("text")):
        rows, h, _, _, _ = Scan(data, offsets, window).units()
        found.append((h, ids[lo + rows]))
    h, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(h):
        return NAMED.empty_table()
    order = np.argsort(h, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
    by = np.argsort(order[begin])  # in order of place, one document's rows stay together
    bucket = np.full(len(by), table.column("bucket")[0].as_py(), dtype=np.int32)
    return pa.Table.from_arrays([pa.array(x) for x in (bucket, h[order[begin]][by], low[by], (high - low)[by])], schema=NAMED)


def spans_of(left: pa.Table, right: pa.Table, window: int, least_bytes: int) -> pa.Table:
    """(doc_id, spans) of every row of the bucket ``left``; right: what is repeated, as (hash, smallest document, component)."""
    wanted, least, component, _ = columns_of(right, 0)
    by = np.argsort(wanted)
    wanted, least, component = wanted[by], least[by], component[by]
    ids, out = left.column("doc_id").to_numpy(), []
    for lo, hi, data, offsets in ts.slices(left.column("text")):
        of: list[list] = [[] for _ in range(hi - lo)]
        rows, h, first, after, _ = Scan(data, offsets, window).units()
        at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
        gone = np.flatnonzero((wanted[at] == h) & (ids[lo + rows] > least[at])) if len(wanted) else []
        if len(gone):
            rows, first, after, own = rows[gone], first[gone], after[gone], component[at[gone]]
            reach = np.maximum.accumulate(after)
            new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (first[1:] > reach[:-1] + 2))))
            last, least_of = np.append(new[1:], len(rows)) - 1, np.minimum.reduceat(own, new)
            start, end = first[new], reach[last]
            for r, a, b, c in zip(rows[new].tolist(), (start - offsets[rows[new]]).tolist(), (end - offsets[rows[new]]).tolist(), least_of.tolist(), strict=True):
                if b - a >= least_bytes:
                    of[r].append({"first": a, "after": b, "component": c})
        out += of
    return pa.Table.from_arrays([left.column("doc_id"), pa.array(out, SPANS)], ["doc_id", "spans"])


def repeated_spans(docs: DataFrame, num: int = 80, den: int = 100, window: int = 12, least_words: int = 8, least_bytes: int = 100, chunk_tokens: int = 400_000) -> DataFrame:
    """(doc_id, spans) per document row: the byte stretches that go, each with the smallest component in it."""
    rows = texts_of(docs, []).select("doc_id", "h", "text")
    some = rows.where("doc_id is not null")
    similar = line_components(some.select("doc_id", "text"), num, den, window, least_words, chunk_tokens)
    known = some.withColumn("bucket", bucket_of(buckets_for(some.select(F.octet_length("text").alias("n")))))
    named = known.groupBy("bucket").applyInArrow(lambda x: name(x, window), spark_schema(NAMED))
    by = Window.partitionBy("h")  # a bucket has one row here
    named = named.withColumn("high", F.col("low") + F.col("more")).withColumns({"least": F.min("low").over(by), "most": F.max("high").over(by)})
    named = named.join(similar.select("h", "component", F.col("low").alias("first")), "h", "left")
    least = F.coalesce("first", "least")
    repeated = named.where((F.col("component").isNotNull() | (F.col("least") < F.col("most"))) & (F.col("high") > least))
    right = beside(0, repeated, F.col("h"), least, F.coalesce("component", "h"))
    found = known.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(lambda x, y: spans_of(x, y, window, least_bytes), SPANS_SCHEMA)
    none = F.array().cast("array<struct<first:long,after:long,component:long>>")
    return found.unionByName(rows.where("doc_id is null").select("doc_id", none.alias("spans")))


def digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_removed, n_spans, spans) per document row: bytes and stretches that go, and the stretches themselves."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    return repeated_spans(docs, **options).select("doc_id", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans")
