"""Benchmark decontamination: a broadcast hash set of normalised test windows against every window of the corpus.

A text is cut into words (lower-case a-z, digits and all non-ASCII characters make words). A window is ``window``
consecutive words of an item; a shorter item is one window. The sorted hashes of all windows, each with its place in the
items, are built once and broadcast; tasks hash the windows of their documents, look them up, and compare the words
themselves with those at the place before they count a hit. Items of more than ``most_chars`` characters in all are not broadcast in one piece but in as many blocks as needed, one
scan of the corpus each.

Defined cases: a null or empty text has no words and no hit; an item without words hits nothing; repeated rows are
judged one by one; an empty benchmark hits nothing; items of equal text are all reported; an item
without an id hits like any other but is not among the items named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

FOUND = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """The words of one text: the slow statement of the rule, for the small side and for verifying hits."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    starts, ends, _ = ts.word_spans(data, np.array([0, len(data)]), ts.ALNUM)
    low = ts.LOWER.astype(np.uint8)[data].tobytes()
    return [low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Windows:
    """The windows of some items: sorted hashes by window length, with the first word of each and its item."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names = [name for name, _ in items]
        texts = [text.encode() for _, text in items]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.low = ts.LOWER.astype(np.uint8)[data].tobytes()
        self.starts, self.ends, counts = ts.word_spans(data, offsets, ts.ALNUM)
        hashes, first = ts.span_hashes(data, self.starts, self.ends), np.cumsum(counts) - counts
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(counts, window)).tolist():
            if not n:
                continue
            own = np.flatnonzero(counts >= window if n == window else counts == n)
            many = counts[own] - n + 1
            item = np.repeat(own, many)
            place = np.arange(len(item)) + np.repeat(first[own] - (np.cumsum(many) - many), many)
            known = ts.runs(hashes, n)[place]
            by = np.lexsort((place, known))
            self.by_length[n] = known[by], place[by], item[by]

    def words_at(self, place: int, n: int) -> list[bytes]:
        return [self.low[a:b] for a, b in zip(self.starts[place : place + n].tolist(), self.ends[place : place + n].tolist(), strict=True)]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Words of each row, and for rows with hits their [first, last] word spans and items."""
        starts, ends, counts = ts.word_spans(data, offsets, ts.ALNUM)
        hashes = ts.span_hashes(data, starts, ends)
        first = np.concatenate(([0], np.cumsum(counts)))
        found: dict[int, tuple[list, set]] = {}
        low = ts.LOWER.astype(np.uint8)
        for n, (known, place, item) in self.by_length.items():
            own = ts.runs(hashes, n)
            at = np.searchsorted(known, own)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own).tolist():
                row = int(np.searchsorted(first, i, side="right")) - 1
                if i + n > first[row + 1]:
                    continue
                w = [low[data[a:b]].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)]
                end = int(np.searchsorted(known, own[i], side="right"))
                ids = {int(item[k]) for k in range(int(at[i]), end) if self.words_at(int(place[k]), n) == w}
                if ids:
                    spans, items = found.setdefault(row, ([], set()))
                    spans.append((i - int(first[row]), i - int(first[row]) + n - 1))
                    items.update(self.names[k] for k in ids)
        return counts, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, window: int, most_chars: int) -> Iterator[Broadcast]:
    """The windows of the items in broadcasts of about ``most_chars`` characters of text (some 12 bytes a character)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // most_chars))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = [(r["item"], r["text"]) for r in part.toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(Windows(rows, window))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_chars: int = 5_000_000) -> DataFrame:
    """(doc_id, n_words, spans, items) per document: hit word spans (merged, inclusive) and the items that hit it."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = list(blocks_of(benchmark, window, most_chars))
    for k, held in enumerate(blocks):
        last = k == len(blocks) - 1

        def scan(batches: Iterator[pa.RecordBatch], held=held, later=k > 0, last=last) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                n_words, spans, names = [np.zeros(0, np.int64)], [], []
                for lo, hi, data, offsets in ts.slices(batch.column(1)):
                    counts, found = known.scan(data, offsets)
                    n_words.append(counts)
                    for row in range(hi - lo):
                        s, i = found.get(row, ((), ()))
                        spans.append(merged(s))
                        names.append(sorted(x for x in i if x is not None))
                if later:  # join what earlier blocks of items found
                    for row, (s, i) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                        spans[row] = merged([*spans[row], *((x["first"], x["last"]) for x in s)])
                        names[row] = sorted({*names[row], *i})
                kept = [] if last else [batch.column(1)]
                found_spans = pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], SPANS)
                yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(np.concatenate(n_words), pa.int64()), found_spans, pa.array(names, pa.list_(pa.string()))], ["doc_id", *["text"][: len(kept)], "n_words", "spans", "items"])

        out = out.mapInArrow(scan, f"doc_id long, {'' if last else 'text string, '}{FOUND}")
    return out


def digest(found: DataFrame) -> DataFrame:
    """The per-document summary of ``hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_chars: int = 5_000_000) -> DataFrame:
    """The documents without any hit, with all their columns; each row is judged by its own text."""
    at, out = docs.columns.index("text"), docs
    for held in blocks_of(benchmark, window, most_chars):

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, data, offsets in ts.slices(batch.column(at)):
                    for row in known.scan(data, offsets)[1]:
                        keep[lo + row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out
