"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point.

The words are the terminals of a trie. Each node has a heavy child, the one with most words below it; the edges to the
others, and the end of a word that goes no further, are light. Merging a node's light subtrees with one character
skipped or replaced into the subtree of the heavy one or of the node, smaller into larger, means that a word is
moved once for each light edge on its path, which are at most log2 of the number of words. Here every such move is a row, and the merged
trie is a key on which terminals meet, so that one shuffle merges all nodes at once. Of a word ``p + c + s`` with light c at node p,
heavy child h:

* ``p + s`` (c skipped; unless s begins with c, so that of a run of equal characters only the last is), ``p + h + s`` (replaced) and
  ``p + h + c + s`` (h skipped in the other word) are looked up among the words;
* light siblings meet in the errata node (p, s), whose terminals are all near each other: at most one a character.

So each pair of near words is met exactly once, whatever child is called heavy; that choice bounds the work only. Nodes are known by a
hash of their prefix; where two share it, they share a heavy child and the result is the same.

Siblings are not expanded into pairs: of an errata node each word takes the count of the others and the best of them. A node near the root
has very many words below it; nodes of ``HOT`` words or more are looked up by broadcast (their number is checked), so that no task has more rows of a node.

A word's form is its near word of largest count (ties: the first in code-point order), if that is at least ``ratio`` times its own;
roots follow forms by pointer doubling: counts grow by ``ratio`` with each form, so some five rounds are enough for any corpus.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash of a run; runs of any length are words; repeated rows count
again; a run that loses its only character is no word; an empty table gives an empty result; other columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import cut, small_enough

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words below a node from which on it is looked up by broadcast.
HOT = 2_000
#: Stands between the halves of an errata key and is no letter.
GAP = "\x00"


def words_of(docs: DataFrame, least_chars: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): the runs of letters, of which one in ``one_in`` by hash has lost a code point, with at least ``least_n`` occurrences."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).where(F.length("run") >= least_chars)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % one_in == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def part(word: str, start: Column, length: Column | None = None) -> Column:
    return F.substring(F.col(word), start, F.length(word) if length is None else length)


def places(words: DataFrame) -> DataFrame:
    """(word, n, i, node, c): each node on a word's path, with the next character, empty at the word's end."""
    each = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("word"))))
    return each.select("word", "n", "i", F.xxhash64("i", part("word", F.lit(1), F.col("i"))).alias("node"), part("word", F.col("i") + 1, F.lit(1)).alias("c"))


def heavy_children(each: DataFrame) -> DataFrame:
    """(node, heavy, size) of the nodes that more than one word passes or ends at and that have a child."""
    children = each.groupBy("node", "c").agg(F.count("*").alias("size"))
    best = F.max(F.when(F.col("c") != "", F.struct("size", "c"))).alias("best")
    return children.groupBy("node").agg(F.sum("size").alias("size"), best).where("size > 1 AND best IS NOT NULL").select("node", F.col("best.c").alias("heavy"), "size")


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, i, c, heavy): the light edges on the words' paths."""
    each = places(words)
    heavy = cut(heavy_children(each))
    hot, rest = heavy.where(F.col("size") >= HOT), heavy.where(F.col("size") < HOT)
    if not small_enough(hot, 500_000):
        return each.join(heavy, "node").where("c <> heavy").select("word", "n", "i", "c", "heavy")
    top = F.broadcast(hot.select("node", "heavy"))
    out = [each.join(top, "node"), each.join(top, "node", "left_anti").join(rest, "node")]
    out = [df.where("c <> heavy").select("word", "n", "i", "c", "heavy") for df in out]
    return out[0].unionByName(out[1])


def better(n: str, word: str) -> Column:
    """Smallest for the largest count, then for the first word."""
    return F.struct((-F.col(n)).alias("minus"), F.col(word).alias("word"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near each word that has any, and the best of them."""
    light = cut(light_edges(words))
    head, rest = part("word", F.lit(1), F.col("i")), part("word", F.col("i") + 2)
    after = part("word", F.col("i") + 2, F.lit(1))
    tails = [F.when((F.col("c") != "") & (F.col("c") != after), F.concat(head, rest)), F.when(F.col("c") != "", F.concat(head, "heavy", rest)), F.concat(head, "heavy", "c", rest)]
    moved = light.select("word", "n", F.explode(F.array(*tails)).alias("other"))
    pairs = moved.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    both = F.array(F.struct("word", better("m", "other").alias("best")), F.struct(F.col("other").alias("word"), better("n", "word").alias("best")))
    met = pairs.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")
    # terminals of an errata node: each is near all others, and its best is the node's best or, for that one, the second
    node = Window.partitionBy("errata")
    ordered = node.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    siblings = light.where("c <> ''").select("word", "n", F.concat(head, F.lit(GAP), rest).alias("errata"))
    siblings = siblings.select("word", F.count("*").over(node).alias("k"), F.first(better("n", "word")).over(ordered).alias("a"), F.nth_value(better("n", "word"), 2).over(ordered).alias("b")).where("k > 1")
    siblings = siblings.select("word", (F.col("k") - 1).alias("n_near"), F.when(F.col("a.word") == F.col("word"), F.col("b")).otherwise(F.col("a")).alias("best"))
    return met.unionByName(siblings).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), each once."""
    words = cut(words)
    found = near(words).select(F.col("word").alias("w"), "n_near", F.col("best.word").alias("form"), (-F.col("best.minus")).alias("form_n"))
    rows = words.join(found, F.col("word") == F.col("w"), "left").drop("w")
    has = F.col("form_n") >= ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # a form's own form stands for it, so that the steps to a root are halved
        links = cut(links)
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = links.join(onward, "root", "left")
        if further.where("next IS NOT NULL").isEmpty():
            break
        links = further.select("word", F.coalesce("next", "root").alias("root"))
    out = rows.join(links.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    """The variants among the words of all texts."""
    return variants(words_of(docs))
