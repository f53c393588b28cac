"""Filter interaction audit: what five filters remove from each source, in every order.

A: fewer than 200 words. B: 100 * distinct words < 50 * words. C: 100 * capital letters A-Z > 2 * code points. D: any of
``#$%&*|``. E: the whole text equals that of a row with a smaller doc_id, wherever that row stands.

E is found by partition refinement. Texts are split into classes by their length in code points, then by the hash of
their first block, then of the next one; after each step classes of one row are dropped. Blocks grow by ``GROWTH``, so that a
text of n code points has O(log n) of them; one scan hashes all of them, and rounds see rows of a few numbers. What
survives is compared in full: the texts of a class are grouped, with map-side combination, so a class of very many
copies sends one text a task. A class of one text gives its smallest doc_id; a class of several, which is a collision of
hashes, is settled by its texts.

Each row then has a mask of the filters that it fails. Rows are counted by source and mask, and every number of the
report follows from how many rows pass each of the 32 subsets of filters: a step of an order removes those that pass
what stood before and fail its own. Hot sources are counted map-side; nothing grows with the rows after that.

Defined cases: null and empty texts are the empty text, of no words, which fails A and equals any other empty text, and
does not fail B or C (0 < 0 is false); texts of any length are read whole; a null source is the part "", as an empty one is; a null doc_id
is never smaller and has none smaller, so such a row never fails E and makes no other fail; rows that repeat a doc_id are counted each, and
fail E only by a smaller one; a document is good or toxic if any of its rows in ``labels`` says so, and rows without labels are neither; an empty
table has no parts and gives no rows; other columns of any name are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, side_of_ids, small_enough

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
FIRST_BLOCK, GROWTH, LAST = 256, 8, 2**31 - 1
SUBSETS = range(1 << len(FILTERS))


def blocks() -> list[tuple[int, int]]:
    """(first code point from 1, length) of the blocks, up to the longest string that there can be."""
    out, start, size = [], 1, FIRST_BLOCK
    while start < LAST:
        out.append((start, min(size, LAST - start)))
        start, size = start + size, size * GROWTH
    return out


def block_hashes(text: Column) -> Column:
    """A hash for each block that the text reaches."""
    return F.filter(F.array(*[F.when(F.length(text) >= a, F.xxhash64(F.substring(text, a, n))) for a, n in blocks()]), lambda h: h.isNotNull())


def fails(text: Column) -> Column:
    """The bits of filters A to D."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    each = [n < 200, 100 * different.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(each)), F.lit(0))


def refined(rows: DataFrame) -> DataFrame:
    """(class) of the rows (size, hashes) that share length and all block hashes with another one; hashes are in the order of the blocks."""
    live = rows.select(F.xxhash64("size").alias("class"), "hashes")
    deepest = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
    for k in range(deepest + 1):
        again = cut(live.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"))
        live = live.join(side_of_ids(again), "class", "left_semi")
        if k < deepest:  # texts that end before this block keep their class
            live = cut(live.select(F.when(F.size("hashes") > k, F.xxhash64("class", F.get("hashes", F.lit(k)))).otherwise(F.col("class")).alias("class"), "hashes"))
    return again


def class_of(size: Column, hashes: Column) -> Column:
    """The class after all blocks, as ``refined`` leaves it."""
    return F.aggregate(hashes, F.xxhash64(size), lambda c, h: F.xxhash64(c, h))


def firsts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text, first, texts): the smallest doc_id of each different text in classes (cut), and how many texts the class has; text is null where it is the only one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.where("doc_id is not null").select(class_of(F.length(text), block_hashes(text)).alias("class"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    each = cut(own.join(side_of_ids(classes), "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("first")))
    count = each.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    alone = count.where("texts = 1").select("class", F.lit(None).cast("string").alias("text"), "first", "texts")
    several = each.join(count.where("texts > 1").select("class", "texts"), "class").select("class", "text", "first", "texts")
    return alone.unionByName(several)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit k for the filter ``FILTERS[k]``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text.alias("text"))
    rows = cut(rows.select("doc_id", "part", fails(F.col("text")).alias("mask"), F.length("text").alias("size"), block_hashes(F.col("text")).alias("hashes")))
    found = cut(firsts(docs, refined(rows)))
    one = found.where("texts = 1").select("class", "first")
    rows = rows.withColumn("class", class_of(F.col("size"), F.col("hashes")))
    same = rows.join(F.broadcast(one) if small_enough(one, 1_000_000) else one, "class", "left")
    same = same.select("doc_id", "part", "mask", "class", (F.col("doc_id") > F.col("first")).alias("e"))
    collided = found.where("texts > 1")
    if not collided.isEmpty():  # hashes of different texts met: these rows are told apart by their texts
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, text.alias("text"), class_of(F.length(text), block_hashes(text)).alias("class"), fails(text).alias("mask"))
        told = own.join(collided.select("class", "text", "first"), ["class", "text"]).select("doc_id", "part", "mask", "class", (F.col("doc_id") > F.col("first")).alias("e"))
        nulls = own.where("doc_id is null").join(collided.select("class").distinct(), "class", "left_semi")
        nulls = nulls.join(collided.select("class", "text"), ["class", "text"], "left_anti").select("doc_id", "part", "mask", "class", F.lit(False).alias("e"))
        same = same.join(collided.select("class").distinct(), "class", "left_anti").select("doc_id", "part", "mask", "class", "e").unionByName(told).unionByName(nulls)
    return same.select("doc_id", "part", (F.col("mask") + F.when(F.col("e"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of rows (doc_id, part, mask)."""
    own = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(own, F.col("doc_id") == F.col("labelled"), "left")
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, filters before as bits, own bit) for every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(order), k + 1, f, before, 1 << FILTERS.index(f)))
            before |= out[-1][-1]
    return out


def report(counted: DataFrame) -> DataFrame:
    """The audit of counts (part, mask, n, good, toxic): a row for each part, order and step."""
    passing = counted.withColumn("subset", F.explode(F.array(*[F.when((F.col("mask").bitwiseAND(s)) == 0, s) for s in SUBSETS]))).where("subset is not null")
    zero = F.lit(0).cast("long")
    sums = passing.groupBy("part", "subset").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # at most 32 entries a part; the empty subset is always there
    by_part = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "good", "toxic")))).alias("p"))
    only = counted.where(F.bit_count("mask") == 1).groupBy(F.col("part").alias("own")).agg(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias(f"only_{f}") for k, f in enumerate(FILTERS)])
    by_part = by_part.join(only, F.col("part") == F.col("own"), "left")

    def at(subset: Column | int, name: str) -> Column:
        return F.coalesce(F.try_element_at("p", F.lit(subset) if isinstance(subset, int) else subset)[name], zero)

    shapley = {}
    for k, f in enumerate(FILTERS):  # an order has the subset before f in |S|! (4 - |S|)! ways
        without = [s for s in SUBSETS if not s >> k & 1]
        shapley[f] = sum((factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) * (at(s, "n") - at(s | 1 << k, "n")) for s in without), zero)
    by_part = by_part.select("part", "p", *[c.alias(f"shapley_{f}") for f, c in shapley.items()], *[F.coalesce(f"only_{f}", zero).alias(f"only_{f}") for f in FILTERS])
    plan = F.array(*[F.struct(F.lit(o).alias("order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before"), F.lit(bit).alias("bit")) for o, s, f, b, bit in steps()])
    each = by_part.withColumn("s", F.explode(plan)).select("*", "s.*")

    def of(prefix: str) -> Column:
        return F.element_at(F.create_map(*[c for f in FILTERS for c in (F.lit(f), F.col(f"{prefix}_{f}"))]), F.col("f"))

    after = F.col("before") + F.col("bit")
    removed = at(F.col("before"), "n") - at(after, "n")
    return each.select(
        "part", F.col("order").alias("filter_order"), "step", at(after, "n").alias("kept"), removed.alias("removed"), (at(0, "n") - at(F.col("bit"), "n") - removed).alias("redundant"), of("only").alias("unique_fails"),
        (at(F.col("before"), "good") - at(after, "good")).alias("good_lost"), (at(F.col("before"), "toxic") - at(after, "toxic")).alias("toxic_lost"), of("shapley").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return report(counts(masks(docs), labels))
