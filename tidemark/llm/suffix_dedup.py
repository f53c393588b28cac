"""Exact removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

0. A document whose whole text stands in one with a smaller id loses everything; only the first of each group of equal
   documents goes on. Documents are dealt by hash into buckets of about ``BUCKET_BYTES``, and one shuffle of the texts by
   bucket serves all passes.
1. Routing. In every window of ``length`` bytes the gram of ``GRAM`` bytes with the smallest hash is its anchor (the first
   of equals), so equal windows have equal anchors at the same place. An anchor owns a run of consecutive windows, whose
   bytes are one piece of at most two windows. A bucket sends one row for each of its anchors; those that stand in two
   or more documents come back. So an anchor that a third of all documents hold has one row a bucket.
2. Of these anchors each bucket sends its different pieces, one row each with the smallest document that holds it, to the
   anchor's task. A window with an equal in another document thus meets it there.
3. A task takes the pieces in slices of whole anchors. Where all pieces of an anchor are equal, the smallest document is
   known at once. Of the others, equal pieces are laid together; a suffix array of the pieces (prefix doubling up to the
   bytes needed), its Burrows-Wheeler transform and the LF mapping are built. Intervals are extended backwards breadth
   first, so the borders between suffixes get their common prefix lengths in rising order, and the expansion stops at
   ``length``: suffixes without a border between them have an equal window. Each window's smallest document decides which
   documents lose it.
4. What goes of a piece meets its bucket's documents, each of which loses it if its id is large enough.

Defined cases: null text is empty; documents shorter than ``length`` lose nothing; strings that only repeat inside one
document, or in rows of one id, stay; rows without an id lose nothing and cause no removal; rows that repeat an id are
judged one by one; an empty table gives an empty result; extra columns of any name are kept apart. Cuts may fall inside a
character, as bytes are asked for; where text is wanted, ``drop_repeats`` widens what stays to whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textscan as ts
from .buckets import beside, bucket_of, buckets_for, columns_of, spark_schema, texts_of
from .shared import cut

GRAM = 20
ROUTE = 48  # an anchor is sent as so many bits of its hash; where two share them, their pieces meet for nothing
SEED_DEPTH = 10  # five bytes, doubled once
BORDER = 0xFF  # in no UTF-8 text


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, gram hash, piece hash, first window, last window) of each anchor, in order of place."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = running(data)
    down = ts.table("down", ts.INVERSE, len(data) + 1)
    grams = ts.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    origin = np.repeat(offsets[:-1], np.diff(offsets))
    place = ts.least_places(grams, length - GRAM + 1, origin)  # equal in the bits that name the anchor, whichever of equals it is
    first, last = offsets[:-1], offsets[1:] - length
    fits = last >= first
    changed = np.flatnonzero(place[1:n] != place[: n - 1]) + 1
    begin = ts.distinct(np.concatenate([changed, first[fits], last[fits] + 1]))
    after = np.append(begin[1:], n)
    rows = np.searchsorted(offsets, begin, side="right") - 1
    inside = np.flatnonzero((begin < n) & (begin <= offsets[np.minimum(rows + 1, len(offsets) - 1)] - length))
    rows, begin, after = rows[inside], begin[inside], after[inside]
    return rows, grams[place[begin]] >> np.uint64(64 - ROUTE), piece_hashes(sums, begin, after + (length - 1)), begin, after - 1


def piece_hashes(sums: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of each stretch first:after of the bytes whose running sums are given."""
    size = (after - first).astype(np.uint64)
    return ts.mix((sums[after] - sums[first]) * ts.table("down", ts.INVERSE, len(sums))[first] + size)


def running(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(ts.BYTE_CODE[data] * ts.table("up", ts.BASE, len(data)), out=sums[1:], dtype=np.uint64)
    return sums


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` or more bytes, doubled from 5; and, in that order, their rank by SEED_DEPTH bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(5, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(5):
        key = (key << np.uint64(8)) | padded[j : j + n]
    known, seed = 5, None
    width = n.bit_length()
    while True:
        order = in_turn(key)
        in_order = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], in_order[1:] != in_order[:-1])), dtype=np.uint64)
        if known == SEED_DEPTH:
            seed = rank
        if known >= max(depth, SEED_DEPTH):
            return order, seed[order]
        ahead = np.zeros(n, dtype=np.uint64)
        if n > known:
            ahead[:-known] = rank[known:]
        key = (rank << np.uint64(width)) | ahead
        known *= 2


def in_turn(key: np.ndarray) -> np.ndarray:
    """The order of keys, equal ones in their order of place."""
    width = max(1, (len(key) - 1).bit_length())
    if int(key.max()).bit_length() + width > 64:
        return np.argsort(key, kind="stable")
    return (np.sort((key << np.uint64(width)) | np.arange(len(key), dtype=np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def equal_windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, in that order, a class number: suffixes of one class have their first ``length`` bytes in common."""
    order, seed = suffix_order(data, length)
    n = len(order)
    transform = data[order - 1]  # the byte before; that of the first suffix is the last byte, a border
    back = np.empty(n, dtype=np.int64)
    back[np.argsort(transform, kind="stable")] = np.arange(n)  # LF mapping
    border = np.ones(n + 1, dtype=bool)
    border[1:n] = seed[1:] != seed[:-1]
    low = np.flatnonzero(border[:-1])
    high = np.flatnonzero(border[1:])
    for _ in range(SEED_DEPTH, length):
        one = low == high
        to_low = to_high = back[low[one]]
        wide_low, wide_high = low[~one], high[~one]
        if len(wide_low):
            sizes = wide_high - wide_low + 1
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(wide_low - (ends - sizes), sizes)
            key = np.repeat(np.arange(len(sizes)), sizes) * 256 + transform[at]
            by = in_turn(key.astype(np.uint64))
            cut = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
            to_low = np.concatenate([to_low, back[at[by[cut]]]])
            to_high = np.concatenate([to_high, back[at[by[np.append(cut[1:], len(by)) - 1]]]])
        new = ~border[to_high + 1]
        low, high = to_low[new], to_high[new]
        if not len(low):
            break
        border[high + 1] = True
    return order, np.cumsum(border[:-1]) - 1


def decide(pieces: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct pieces and the smallest document of each: the smallest document of every window, laid end to end, and where each piece's begin."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(bytes([BORDER]).join(pieces) + bytes([BORDER]), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    order, group = equal_windows(data, length)
    windows = sizes - length + 1
    ends = np.cumsum(windows)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - windows), windows)
    document = np.full(len(data), np.iinfo(np.int64).max)
    document[at] = np.repeat(least, windows)
    smallest = np.minimum.reduceat(document[order], np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    of = np.empty(len(data), dtype=np.int64)
    of[order] = smallest[group]
    return of[at], np.concatenate(([0], ends))


def lost(doc: np.ndarray, piece: np.ndarray, gram: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(row, first byte, byte after the last) of what the smallest document of each row (one piece in one bucket) loses."""
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, doc)
    of = np.zeros(len(texts), dtype=np.int64)
    of[piece] = gram
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    _, which, many = np.unique(of, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(many[which] > 1)  # pieces that stand beside others of their anchor
    low, high, at = least.copy(), least.copy(), np.full(len(texts), -1)
    if len(open_):
        smallest, begin = decide([texts[i] for i in open_.tolist()], least[open_], length)
        low[open_], high[open_], at[open_] = np.minimum.reduceat(smallest, begin[:-1]), np.maximum.reduceat(smallest, begin[:-1]), np.arange(len(open_))
    whole = np.flatnonzero(doc > high[piece])
    rows, first, after = [whole], [np.zeros(len(whole), np.int64)], [sizes[piece[whole]]]
    for i in np.flatnonzero((doc > low[piece]) & (doc <= high[piece])).tolist():
        k = at[piece[i]]
        gone = np.flatnonzero(smallest[begin[k] : begin[k + 1]] < doc[i])
        edges = np.flatnonzero(np.diff(gone) > 1)
        rows.append(np.full(len(edges) + 1, i))
        first.append(gone[np.concatenate(([0], edges + 1))])
        after.append(gone[np.concatenate((edges, [len(gone) - 1]))] + length)
    return np.concatenate(rows), np.concatenate(first), np.concatenate(after)


def told(rows: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, h) of rows whose whole text stands in a smaller id, cut; and the number of buckets for all rows."""
    hashed = rows.where("doc_id is not null").select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").alias("n"))
    hashed = cut(hashed)
    first = hashed.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = hashed.join(first, ["h", "h2", "n"]).where("doc_id > low").select("doc_id", "h").distinct()
    return cut(copies), buckets_for(hashed)


COPY, ANCHOR, PART = 0, 1, 2
WIDTH = 32  # a part's first byte and the byte after its last, both inside a piece, are sent as one number


def copies_in(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Which rows of the bucket are copies of documents with a smaller id."""
    doc, h, _, _ = columns_of(right, COPY)
    known = set(zip(doc.tolist(), h.tolist(), strict=True))
    rows = zip(left.column("doc_id").to_pylist(), left.column("h").to_pylist(), strict=True)
    return np.fromiter((x in known for x in rows), dtype=bool, count=left.num_rows)


def segments(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, equal ones by place, and where each run of equal keys begins in it."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)


NAMED = pa.schema([("bucket", pa.int32()), ("gram", pa.int64())])
FOUND = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("low", pa.int64()), ("more", pa.int64()), ("piece", pa.binary())])
GONE = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("h", pa.int64()), ("part", pa.int64()), ("above", pa.int64())])


def name(left: pa.Table, right: pa.Table, length: int) -> pa.Table:
    """One row for each anchor of a bucket, twice the bucket's number, or one more if two of its documents hold the anchor."""
    own = left.filter(pa.array(~copies_in(left, right)))
    ids, found = own.column("doc_id").to_numpy(), []
    for lo, _, data, offsets in ts.slices(own.column("text")):
        rows, grams, _, _, _ = anchors(data, offsets, length)
        found.append((ids[lo + rows], grams))
    doc, grams = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids, np.zeros(0, np.uint64))
    if not len(grams):
        return NAMED.empty_table()
    order, begin = segments(grams)
    several = np.minimum.reduceat(doc[order], begin) < np.maximum.reduceat(doc[order], begin)
    bucket = (2 * left.column("bucket")[0].as_py() + several).astype(np.int32)
    return pa.Table.from_arrays([pa.array(bucket), pa.array(ts.signed(grams[order[begin]]))], schema=NAMED)


def take_part(left: pa.Table, right: pa.Table, length: int) -> pa.Table:
    """The different pieces of the wanted anchors in a bucket, each with its smallest document and the largest less that."""
    wanted = ts.distinct(columns_of(right, ANCHOR)[0])
    own = left.filter(pa.array(~copies_in(left, right)))
    ids, found, pieces = own.column("doc_id").to_numpy(), [], {}
    for lo, _, data, offsets in ts.slices(own.column("text")) if len(wanted) else ():
        rows, grams, h, low, high = anchors(data, offsets, length)
        grams = ts.signed(grams)
        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)] == grams)
        held = data.tobytes()
        for k, a, b in zip(h[at].tolist(), low[at].tolist(), high[at].tolist(), strict=True):
            if k not in pieces:
                pieces[k] = held[a : b + length]
        found.append((ids[lo + rows[at]], grams[at], h[at]))
    if not pieces:
        return FOUND.empty_table()
    doc, grams, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order, begin = segments(h)
    low, high = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
    bucket = np.full(len(begin), left.column("bucket")[0].as_py(), dtype=np.int32)
    texts = [pieces[k] for k in h[order[begin]].tolist()]
    return pa.Table.from_arrays([pa.array(bucket), pa.array(grams[order[begin]]), pa.array(low), pa.array(high - low), pa.array(texts, pa.binary())], schema=FOUND)


def settle(seen: pa.Table | None, new: pa.Table, length: int) -> tuple[pa.Table, pa.RecordBatch]:
    """What goes of the pieces ``new``, and one row of each piece of the last anchor, which later slices have to meet."""
    table, old = (new, 0) if seen is None else (pa.concat_tables([seen, new]), seen.num_rows)
    coded = table.column("piece").combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    doc, piece, gram = table.column("low").to_numpy(), coded.indices.to_numpy().astype(np.int64), table.column("gram").to_numpy()
    texts = coded.dictionary.to_pylist()
    rows, first, after = lost(doc, piece, gram, texts, length)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # all others of the bucket that hold the piece lose it whole to the smallest
    others = np.flatnonzero(table.column("more").to_numpy() > 0)
    above = np.concatenate([doc[rows] - 1, doc[others]])
    rows = np.concatenate([rows, others])
    first, after = np.concatenate([first, np.zeros(len(others), np.int64)]), np.concatenate([after, sizes[piece[others]]])
    fresh = rows >= old
    rows, first, after, above = rows[fresh], first[fresh], after[fresh], above[fresh]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    h = ts.signed(piece_hashes(running(data), ends - sizes, ends))[piece[rows]]
    last = np.flatnonzero(gram == gram[-1])
    keep = last[np.unique(piece[last], return_index=True)[1]]  # the first row of a piece has its smallest document
    gone = [table.column("bucket").to_numpy()[rows], gram[rows], h, (first << WIDTH) | after, above]
    return table.take(pa.array(np.sort(keep))), pa.RecordBatch.from_arrays([pa.array(x) for x in gone], schema=GONE)


def keys_of(gram: np.ndarray, h: np.ndarray) -> np.ndarray:
    return ts.mix(gram.view(np.uint64) * ts.BASE ^ h.view(np.uint64))


def own_ranges(left: pa.Table, right: pa.Table, length: int) -> list[list[tuple[int, int]]]:
    """The byte ranges that each row of the bucket loses."""
    gone: list[list[tuple[int, int]]] = [[] for _ in range(left.num_rows)]
    copies = copies_in(left, right)
    for i, n in zip(np.flatnonzero(copies).tolist(), pc.binary_length(left.column("text")).filter(pa.array(copies)).to_pylist(), strict=True):
        if n >= length:
            gone[i].append((0, n))
    gram, h, part, above = columns_of(right, PART)
    keys = keys_of(gram, h)
    order = np.argsort(keys, kind="stable")
    keys, part, above = keys[order], part[order], above[order]
    ids = left.column("doc_id").to_numpy()
    for lo, _, data, offsets in ts.slices(left.column("text")) if len(keys) else ():
        rows, grams, pieces, low, _ = anchors(data, offsets, length)
        wanted = keys_of(grams, pieces)
        begin, end = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
        n = end - begin
        at = np.repeat(np.arange(len(n)), n)
        which = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + begin[at]
        hit = (ids[lo + rows[at]] > above[which]) & ~copies[lo + rows[at]]
        at, which = at[hit], which[hit]
        start = low[at] - offsets[rows[at]]
        for r, a, b in zip((lo + rows[at]).tolist(), (start + (part[which] >> WIDTH)).tolist(), (start + (part[which] & ((1 << WIDTH) - 1))).tolist(), strict=True):
            gone[r].append((a, b))
    return gone


def removed_parts(known: DataFrame, notes: DataFrame, length: int = 50, slice_bytes: int = 500_000) -> DataFrame:
    """(bucket, gram, h, part, above): a part of the piece h of an anchor that goes from the bucket's documents of ids above."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor and rising document, so what a later slice needs of an anchor is one row of each piece seen so far."""
        seen, held, size = None, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(4).nbytes
            if size >= slice_bytes:
                seen, out = settle(seen, pa.Table.from_batches(held), length)
                yield out
                held, size = [], 0
        if sum(x.num_rows for x in held):
            yield settle(seen, pa.Table.from_batches(held), length)[1]

    by_bucket = known.groupBy("bucket")
    named = by_bucket.cogroup(notes.groupBy("bucket")).applyInArrow(lambda x, y: name(x, y, length), spark_schema(NAMED))
    by = Window.partitionBy("gram")  # a bucket has one row here
    counted = named.withColumns({"n": F.count("*").over(by), "several": F.max(F.col("bucket") % 2).over(by)})
    repeated = counted.where("n > 1 or several = 1").select("gram", F.shiftright("bucket", 1).alias("bucket"))
    wanted = notes.unionByName(beside(ANCHOR, repeated, F.col("gram")))
    found = by_bucket.cogroup(wanted.groupBy("bucket")).applyInArrow(lambda x, y: take_part(x, y, length), spark_schema(FOUND))
    return found.repartition("gram").sortWithinPartitions("gram", "low").mapInArrow(judge, spark_schema(GONE))


def kept_ranges(n: int, ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """What stays of n bytes, how many go, and in how many runs."""
    stay, at, gone, spans = [], 0, 0, 0
    end = -1
    for a, b in sorted(ranges):
        if a > end:
            spans += 1
            if a > at:
                stay.append((at, a))
        if b > end:
            gone += b - max(a, end if a <= end else a)
            end = b
        at = max(at, b)
    if at < n:
        stay.append((at, n))
    return stay, gone, spans


def with_ranges(docs: DataFrame, length: int, kept: list[str], judged: Callable[[pa.Table, list], pa.Table], schema: StructType | str) -> DataFrame:
    """``judged`` of every bucket: it gets rows (doc_id, h, text, kept) and the byte ranges that each of them loses."""
    rows = texts_of(docs, kept)
    copies, buckets = told(rows)
    known = rows.where("doc_id is not null").withColumn("bucket", bucket_of(buckets))
    notes = beside(COPY, copies.select(bucket_of(buckets), "doc_id", "h"), F.col("doc_id"), F.col("h"))
    parts = removed_parts(known, notes, length)
    right = notes.unionByName(beside(PART, parts, F.col("gram"), F.col("h"), F.col("part"), F.col("above")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return judged(left, own_ranges(left, right, length))

    return known.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(meet, schema)


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per document row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def judged(left: pa.Table, gone: list) -> pa.Table:
        out = []
        for lo, hi, data, offsets in ts.slices(left.column("text")):
            held = data.tobytes()
            for r in range(hi - lo):
                text = held[offsets[r] : offsets[r + 1]]
                stay, lost_bytes, spans = kept_ranges(len(text), gone[lo + r])
                kept = b"".join(text[a:b] for a, b in stay) if lost_bytes else text
                out.append((len(text), lost_bytes, spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([left.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    whole = with_ranges(docs, length, [], judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    others = texts_of(docs, []).where("doc_id is null")
    none = F.lit(0).cast("long")
    return whole.unionByName(others.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


def drop_repeats(docs: DataFrame, length: int = 50, least_left: int = 1) -> DataFrame:
    """The documents with repeated strings cut out of their text and all other columns as they are.

    A character of which only some bytes repeat stays whole. Documents of which less than ``least_left`` characters other
    than white space stay are dropped, unless they had no more at the start.
    """
    columns = docs.columns
    at = columns.index("text")

    def judged(left: pa.Table, gone: list) -> pa.Table:
        row = left.column("kept").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        null, *own = (pc.struct_field(row, [i]) for i in range(len(columns)))
        texts = pc.if_else(null, pa.scalar(None, pa.string()), left.column("text").combine_chunks()).to_pylist()
        keep = np.ones(left.num_rows, dtype=bool)
        for r, ranges in enumerate(gone):
            if not ranges:
                continue
            data = texts[r].encode()
            stay, parts = kept_ranges(len(data), ranges)[0], []
            for a, b in stay:
                while a > 0 and data[a] & 0xC0 == 0x80:
                    a -= 1
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b += 1
                parts.append(data[a:b].decode())
            texts[r] = "".join(parts)
            keep[r] = len("".join(texts[r].split())) >= least_left
        own.insert(at, pa.array(texts, pa.string()))
        return pa.Table.from_arrays(own, columns).filter(pa.array(keep))

    return with_ranges(docs, length, [c for c in columns if c != "text"], judged, docs.schema).unionByName(docs.where("doc_id is null"))
