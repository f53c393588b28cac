"""Vectorised text helpers that run inside Arrow map tasks.

All of them work on the UTF-8 bytes of a slice of rows at once. Slices hold about a quarter of a megabyte (a single longer text
makes a slice of its own), so that the temporary arrays stay small whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_CODE = BYTE_CODE[LOWER]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _POWERS or len(_POWERS[name]) < n:
        _POWERS[name] = powers(base, max(n, SLICE_BYTES + 1))
    return _POWERS[name][:n]


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        lo, hi = offsets[row], offsets[end]
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside a row, and how many words each row has."""
    inside = is_word[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[1:], before[0] = inside[:-1], False
        after[:-1], after[-1] = inside[1:], False
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans, ASCII capitals as small letters if ``lower``; equal spans hash alike anywhere."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER_CODE if lower else BYTE_CODE)[data] * table("up", BASE, len(data)), out=sums[1:], dtype=np.uint64)
    raw = (sums[ends] - sums[starts]) * table("down", INVERSE, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * BASE + hashes[j : j + n]
    return mix(out)


def minimum_places(values: np.ndarray, want: int) -> np.ndarray:
    """For each window of ``want`` values the place of the smallest, of equals the first."""
    least, place, width = values, np.arange(len(values), dtype=np.int32), 1
    while width < want:
        step = min(width, want - width)
        left = least[:-step] <= least[step:]
        place = np.where(left, place[:-step], place[step:])
        least = np.where(left, least[:-step], least[step:])
        width += step
    return place


def least_places(values: np.ndarray, want: int, origin: np.ndarray) -> np.ndarray:
    """For each window of ``want`` values the place of the smallest, by all bits but the lowest that number a window's places.

    Of equals the one that comes first by those bits of its distance from ``origin``, so that it depends on the row alone.
    """
    if want > 1 << 16:
        raise ValueError("windows of more than 65536 values leave too few bits to tell values apart")
    low = np.uint64((1 << want.bit_length()) - 1)
    at = (np.arange(len(values), dtype=np.int64) - origin[: len(values)]).view(np.uint64)
    least, width = (values & ~low) | (at & low), 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return np.arange(len(least)) + ((least - at[: len(least)]) & low).view(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    own = np.sort(values)
    return own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of each stretch hashes[first:after]."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * table("up", BASE, len(hashes)), out=sums[1:], dtype=np.uint64)
    return mix((sums[after] - sums[first]) * table("down", INVERSE, len(hashes) + 1)[first] + (after - first).astype(np.uint64))


def row_runs(hashes: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row, its k-word shingles in order; a row of fewer words gives its whole sequence as one, one without words none."""
    whole = runs(hashes, k)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield whole[at : at + n - k + 1]
        elif n:
            yield runs(hashes[at : at + n], n)
        else:
            yield whole[:0]
        at += n


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
