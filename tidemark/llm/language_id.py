"""Language identification by words first, character n-grams after.

Fit: each training document's distinct words are counted by language (one shuffle of distinct words after partial
aggregation), over a sample of at most ``most_docs`` different training texts, those whose hash lies below a bound
(all, if there are fewer): the bound is set for nine tenths of ``most_docs``, which leaves chance fifteen standard
deviations of room. No task takes the sample whole. Words that occur ``least`` times become known words; the n-grams of
one to ``longest`` characters of all counted words, with a word border at either end, form the back-off tables; single
characters and those counted ``least_grams`` times are kept, as one seen once says less than its parts. A run of more
than ``LONG`` letters (text without spaces) is no word but gives its n-grams like any other. The tables are sorted arrays
of 64-bit keys with one row of log frequencies a key, so their size is that of the sample times the number of languages;
they are broadcast.

Predict: a known word scores its per-language log frequency. Another word is covered from its start by the longest
known n-gram at each place, falling back to shorter ones down to single characters, each at its per-language log
frequency less a penalty for each step back; a run is read whole and weighs as one word for every ``LONG`` letters begun.
The scores of a document's words add up; the posterior of the best language (even prior, scores averaged over at most
``full_weight`` words' evidence) is the score. Ties go to the smaller name.

Defined cases: null text, or one without a letter, is ``und`` with score 0; text whose words are all unknown down to
their characters gets even scores; without any training row everything is ``und``; extra columns are ignored; repeated
rows are each predicted; a very long text is read whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

SPARK_WORD = r"\p{L}+"
#: Letters from which on a run is no word but text without spaces.
LONG = 40
#: Bytes of text that are judged at once; a longer text is judged alone.
SLICE = 1 << 18
STEP_BACK = math.log(0.4)
BEGIN, END = ord("^"), ord("$")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, dtype=bool)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and where each text begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def codes(points: np.ndarray) -> np.ndarray:
    return ts.mix((points.astype(np.uint64) + np.uint64(1)) * ts.BASE)


def bordered(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words points[start:end] with their borders, laid end to end: code points, where each begins, where it ends."""
    inner = ends - starts
    after = np.cumsum(inner + 2)
    begin = after - inner - 2
    out = np.full(int(after[-1]) if len(after) else 0, END, dtype=np.uint32)
    out[begin] = BEGIN
    place = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
    out[place + np.repeat(begin + 1, inner)] = points[place + np.repeat(starts, inner)]
    return out, begin, after


def gram_counts(words: list[str], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, index of the word) of all that the words count for: kind 0 for a whole word, n for an n-gram."""
    points, offsets = characters(words)
    size = np.diff(offsets)
    short = np.flatnonzero(size <= LONG)
    yield 0, ts.sequence_hashes(codes(points), offsets[:-1][short], offsets[1:][short]), short
    text, begin, after = bordered(points, offsets[:-1], offsets[1:])
    of = np.repeat(np.arange(len(words)), after - begin)
    left, own = np.repeat(after, after - begin) - np.arange(len(text)), codes(text)
    for n in range(1, longest + 1):
        at = np.flatnonzero(left >= n)
        yield n, ts.runs(own, n)[at], of[at]


def fit(rows: DataFrame, most_docs: int = 20_000, longest: int = 5, least: int = 2, least_grams: int = 2) -> dict:
    """The model from rows (text, lang). Counts are aggregated by Spark; only the tables come back.

    langs: sorted names; words: (keys, logs) of the known words; grams: a sorted key array for each length, with ``base``
    the place of its first row in ``logs``, which already holds the penalty of the steps back.
    """
    usable = rows.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    share = 0.9 * most_docs / max(1, usable.agg(F.approx_count_distinct("h", 0.01)).first()[0])
    if share < 1:
        usable = usable.where(F.col("h") < int(-(2**63) + share * 2**64))
    sample = usable.groupBy("h", "lang").agg(F.min("text").alias("text"))  # copies are one before the exchange
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_WORD), F.lit(0))).alias("word")
    counts = sample.select("lang", found).groupBy("lang", "word").agg(F.count("*").alias("n"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in ts.slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                coded = part.column(0).dictionary_encode()
                lang, n = coded.indices.to_numpy().astype(np.int64), part.column(2).to_numpy()
                for kind, keys, of in gram_counts(part.column(1).to_pylist(), longest):
                    if not len(keys):
                        continue
                    order = np.lexsort((lang[of], keys))
                    keys, of = keys[order], of[order]
                    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (lang[of][1:] != lang[of][:-1]))))
                    names = coded.dictionary.take(pa.array(lang[of[new]]))
                    sums = np.add.reduceat(n[of], new)
                    kinds = np.full(len(new), kind, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([names, pa.array(kinds), pa.array(ts.signed(keys[new])), pa.array(sums)], ["lang", "kind", "key", "n"])

    pieces = counts.mapInArrow(expand, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    least_of = F.when(F.col("kind") == 0, least).when(F.col("kind") == 1, 1).otherwise(least_grams)
    return model_of(pieces.where(F.col("n") >= least_of).toArrow(), longest)  # what the sample holds, and it is bounded


def model_of(table: pa.Table, longest: int) -> dict:
    """The model from counts (lang, kind, key, n)."""
    coded = table.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    lang = np.array([langs.index(x) for x in names], dtype=np.int64)[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    kind, key, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    keys, logs, base = [], [], [0]
    for k in range(longest + 1):
        own = kind == k
        distinct, row = np.unique(key[own].view(np.uint64), return_inverse=True)
        count = np.zeros((len(distinct), len(langs)))
        count[row, lang[own]] = n[own]
        share = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * max(len(distinct), 1)))
        keys.append(distinct)
        logs.append((share + (STEP_BACK * (longest - k) if k else 0)).astype(np.float32))
        if k:
            base.append(base[-1] + len(distinct))
    return {"langs": langs, "longest": longest, "words": (keys[0], logs[0]), "grams": keys[1:], "base": base, "logs": np.concatenate(logs[1:])}


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def is_known(model: dict, words: list[str]) -> np.ndarray:
    """Whether each word has a frequency of its own."""
    points, offsets = characters(words)
    return looked_up(model["words"][0], ts.sequence_hashes(codes(points), offsets[:-1], offsets[1:]))[1]


def weights(sizes: np.ndarray) -> np.ndarray:
    """How many words runs of so many letters weigh as."""
    return np.maximum(1, -(-sizes // LONG))


def backed_off(model: dict, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The scores of unknown words points[start:end], a row a word."""
    text, begin, after = bordered(points, starts, ends)
    left, own = np.repeat(after, after - begin) - np.arange(len(text)), codes(text)
    best, row = np.zeros(len(text), dtype=np.int8), np.zeros(len(text), dtype=np.int64)
    for n, keys in enumerate(model["grams"], 1):
        at, there = looked_up(keys, ts.runs(own, n))
        there = np.flatnonzero(there & (left[: len(at)] >= n))
        best[there], row[there] = n, model["base"][n - 1] + at[there]
    steps, picked, parts = best.tolist(), [], []
    for place, end in zip(begin.tolist(), after.tolist(), strict=True):
        before = len(picked)
        while place < end:
            if n := steps[place]:
                picked.append(place)
                place += n
            else:
                place += 1
        parts.append(len(picked) - before)
    parts = np.array(parts, dtype=np.int64)
    out = np.zeros((len(parts), len(model["langs"])))
    some = np.flatnonzero(parts)
    if len(some):
        out[some] = np.add.reduceat(model["logs"][row[picked]].astype(np.float64), (np.cumsum(parts) - parts)[some], axis=0)
    most = 2 * weights(ends - starts)
    return out * np.where(parts > most, most / np.maximum(parts, 1), 1.0)[:, None]


def judged(model: dict, texts: list[str | None], full_weight: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """For each text the place of its language among the model's (-1 for ``und``) and its score."""
    pred, score = np.full(len(texts), -1), np.zeros(len(texts))
    if not model["langs"]:
        return pred, score
    points, offsets = characters([(t or "").lower() for t in texts])
    starts, ends, counts = ts.word_spans(points, offsets, letters())
    if not len(starts):
        return pred, score
    keys, first, of = np.unique(ts.sequence_hashes(codes(points), starts, ends), return_index=True, return_inverse=True)
    at, known = looked_up(model["words"][0], keys)
    each = np.empty((len(keys), len(model["langs"])))
    each[known] = model["words"][1][at[known]]
    other = first[~known]
    if len(other):
        each[~known] = backed_off(model, points, starts[other], ends[other])
    rows = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[rows]
    total = np.add.reduceat(each[of], begin, axis=0)
    best = total.argmax(axis=1)  # the first of the best: names are sorted
    share = np.minimum(1.0, full_weight / np.add.reduceat(weights(ends - starts), begin))
    gap = (total - total[np.arange(len(rows)), best][:, None]) * share[:, None]
    pred[rows], score[rows] = best, 1.0 / np.exp(gap).sum(axis=1)
    return pred, score


def judge(model: dict, text: str | None, full_weight: int = 20) -> tuple[str, float]:
    pred, score = judged(model, [text], full_weight)
    return (model["langs"][pred[0]] if pred[0] >= 0 else "und"), float(score[0])


def judged_column(model: dict, column: pa.Array, full_weight: int) -> tuple[np.ndarray, np.ndarray]:
    """``judged`` of a whole column, slice by slice."""
    found = [judged(model, column.slice(lo, hi - lo).to_pylist(), full_weight) for lo, hi, _, _ in ts.slices(column, SLICE)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def predict(docs: DataFrame, model: dict, full_weight: int = 20) -> DataFrame:
    """(doc_id, lang_pred, score) per document row, over whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["und", *held.value["langs"]], pa.string())
        for batch in batches:
            pred, score = judged_column(held.value, batch.column(1), full_weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(pred + 1)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, least_score: float = 0.5, full_weight: int = 20) -> DataFrame:
    """The documents that have a language, with all their columns: neither ``und`` nor below ``least_score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = judged_column(held.value, batch.column(at), full_weight)
            yield batch.filter(pa.array((pred >= 0) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def train_and_predict(docs: DataFrame, **options) -> DataFrame:
    """Fit on the rows that aren't held out, predict every row: (doc_id, held_out, lang_pred, score)."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
