"""Byte-level BPE: texts to token ids by a table of ranks, and ids back to bytes.

A text is split by the tokenizer's pattern and each piece is encoded by itself. A piece that is in the table is its
token. Otherwise it starts as single bytes; a segment tree over the byte positions holds in each leaf the rank of the
pair that starts there (above every rank where there is none) and in each node the smallest of its leaves, the leftmost
of equal ones. A merge takes the root's pair and changes three leaves: the merged token's own, its left neighbour's
and that of the position that is no longer a start. So a piece of n bytes takes O(n log n) steps, however long it is.
Pieces of at most ``SCANNED`` bytes, as words are, make no tree: the list of their pairs' ranks is scanned for the smallest.

Both directions are narrow: rows are encoded where they lie, nothing is shuffled and a lost executor costs its own rows.
The ranks are read on the driver and broadcast; a file above ``MOST_BYTES`` is refused, as a vocabulary does not grow
with the corpus. Pieces met before are looked up; twice ``KEPT`` are kept a Python worker at most, so memory is bounded.

Defined cases: null and empty texts have no tokens and decode to no bytes; a null doc_id is kept; repeated rows are rows
of their own; texts of any length are encoded whole; equal ranks do not occur in a table, equal pairs in a piece are
merged from the left; an empty table gives an empty result; columns other than doc_id and text are left out, so no name
clashes. Ids that the table does not have, null among them, decode to null for the whole row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest rank file that is broadcast.
MOST_BYTES = 16_000_000
#: Pieces in a generation of those whose ids a worker keeps, and the longest that is worth keeping.
KEPT, KEPT_CHARS = 150_000, 40
#: Longest piece in bytes whose pairs are scanned at each merge; a tree is slower below some 70.
SCANNED = 64
#: Characters of text that are encoded before a batch goes out.
BATCH_CHARS = 2_000_000
NONE = 1 << 62


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 of the bytes, space, rank"; a path without a scheme is one of the driver's."""
    if "://" in path:
        held = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").first()
        data = bytes(held["content"]) if held else None
    else:
        with open(path, "rb") as file:
            data = file.read(MOST_BYTES + 1)
    if data is None or len(data) > MOST_BYTES:
        raise ValueError(f"{path}: more than {MOST_BYTES} bytes are no vocabulary to broadcast")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{path}: no rank for bytes {missing[:5]}")
    if len(set(ranks.values())) != len(ranks):
        raise ValueError(f"{path}: ranks are not unique")
    return ranks


def put(least: list[int], leaf: int, value: int) -> None:
    """Changes a leaf of the tree ``least``, whose node k has the children 2k and 2k + 1, and what stands above it."""
    if least[leaf] == value:
        return
    least[leaf] = value
    while leaf > 1:
        sibling = least[leaf ^ 1]
        if sibling < value:
            value = sibling
        leaf >>= 1
        if least[leaf] == value:
            return
        least[leaf] = value


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    return by_scan(piece, ranks) if len(piece) <= SCANNED else by_tree(piece, ranks)


def by_scan(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of a piece by merging the leftmost pair of smallest rank, in a number of steps that grows with the square of its length."""
    rank_of, starts = ranks.get, list(range(len(piece) + 1))
    least = [rank_of(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]  # of each token and the next one
    while least and (low := min(least)) < NONE:
        at = least.index(low)
        del starts[at + 1], least[at]
        if at < len(least):
            least[at] = rank_of(piece[starts[at] : starts[at + 2]], NONE)
        if at:
            least[at - 1] = rank_of(piece[starts[at - 1] : starts[at + 1]], NONE)
    return tuple([ranks[piece[a:b]] for a, b in pairwise(starts)])


def by_tree(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same in O(n log n) steps."""
    n, rank_of = len(piece), ranks.get
    least = [NONE] * (2 * n)  # leaf n + i is for the pair that starts at i
    for i in range(n - 1):
        if (rank := rank_of(piece[i : i + 2])) is not None:
            least[n + i] = rank * n + i  # the position makes the leftmost of equal ranks the smallest
    for k in range(n - 1, 0, -1):
        a, b = least[2 * k], least[2 * k + 1]
        least[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # next and previous start
    while n and (low := least[1]) < NONE:
        at = low % n
        gone = after[at]
        end = after[at] = after[gone]
        put(least, n + gone, NONE)
        rank = None
        if end < n:
            before[end] = at
            rank = rank_of(piece[at : after[end]])
        put(least, n + at, NONE if rank is None else rank * n + at)
        if (left := before[at]) >= 0:
            rank = rank_of(piece[left:end])
            put(least, n + left, NONE if rank is None else rank * n + left)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return tuple(out)


class Pieces(dict):
    """Ids of the pieces met of late: of two generations the older goes when the newer is full, so that frequent pieces stay."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = merged(piece.encode(), self.ranks)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks and the pieces met of late. Spark keeps a broadcast value in a Python worker, so the pieces serve the tasks that follow there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pieces = ranks, Pieces(ranks)

    def __reduce__(self):
        return Vocabulary, (self.ranks,)


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text; ``vocabulary`` is a broadcast ``Vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = regex.compile(pattern).findall, vocabulary.value.pieces

        def out(batch: pa.RecordBatch, lo: int, rows: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), ids], ["doc_id", "ids"])

        for batch in batches:
            lo, rows, chars = 0, [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                rows.append(np.fromiter(chain.from_iterable(map(pieces.__getitem__, split(text))), np.int32))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield out(batch, lo, rows)
                    lo, rows, chars = k + 1, [], 0
            yield out(batch, lo, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of every row's ids, null where an id is not in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.ranks
        top = max(known.values()) + 2  # the last place stands for ids that the table does not have
        size, start = np.full(top, -1, np.int64), np.zeros(top, np.int64)
        at = 0
        for token, rank in known.items():
            size[rank], start[rank] = len(token), at
            at += len(token)
        data = np.frombuffer(b"".join(known), np.uint8)
        for batch in batches:
            found: list[bytes | None] = []
            for row in batch.column(1):
                ids = pa.array([], pa.int32()) if row.values is None else row.values
                ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.where((ids < 0) | (ids >= top - 1), top - 1, ids)
                n = size[ids]
                if (n < 0).any():
                    found.append(None)
                    continue
                ends = np.cumsum(n)  # byte k of the output is byte k - (its token's first place) of the token
                places = np.arange(n.sum()) + np.repeat(start[ids] - (ends - n), n)
                found.append(data[places].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded by the ranks of ``path``, then decoded."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(docs.sparkSession, path)))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(docs, vocabulary, pattern), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
