"""Temperature mixing of sources, with DataFrame functions only.

Each source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as they come) and normalised
to weights. The exponent is the largest that keeps the target: entropy of the weights of at least ``target_entropy``
(in nats), or at most ``most_repeats`` passes over any source. It is found by bisection, and clamped to the nearer end
where no exponent reaches the target. The budget is the number of tokens at which the source that is used least is
passed over exactly once, so that no document is lost, or ``budget_tokens`` if given.

Budgets become block permutations: a source's documents are dealt by hash into blocks of about ``block_tokens`` tokens;
each epoch orders the blocks, and the documents inside a block, by a hash of seed and epoch; documents are placed as
long as the tokens before them are below the source's budget. Running sums are taken over groups of about ``GROUP``
blocks, over the blocks of a group and over the documents of a block, so that a source with a third of all rows is never
ordered in one task.

Defined cases: null text counts no tokens; such documents are placed like others; null sources form one source of their own; a source
without any token gets one pass; a null doc_id is placed like any other; an empty table gives an empty result; repeated rows are placed as documents of their own, in the order of all their columns used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BISECTIONS = 60
#: Blocks to a group, about.
GROUP = 4_096


def tokens_of(text: Column) -> Column:
    """White-space separated words, counted without splitting the text."""
    t = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.coalesce(F.when(t == "", 0).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1), F.lit(0)).cast("long")


def exponent(totals: DataFrame, target_entropy: float | None, most_repeats: float | None) -> DataFrame:
    """One row (alpha, norm, least): the bisected exponent, the sum of the raised shares, the smallest of raised share over share.

    totals: (source, tokens), one row a source. The rows become one array of shares, which is bounded by the number of
    sources, and each bisection step is an aggregate over that array.
    """
    shares = totals.where("tokens > 0").agg(F.collect_list(F.col("tokens").cast("double")).alias("n"), F.sum("tokens").cast("double").alias("all"))
    shares = shares.select(F.array_sort(F.transform("n", lambda x: x / F.col("all"))).alias("s"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def keeps(alpha: Column) -> Column:
        raised = F.transform("s", lambda p: F.pow(p, alpha))
        if target_entropy is not None:
            norm = total(raised)
            return -total(F.transform(raised, lambda r: (r / norm) * F.log(r / norm))) >= target_entropy
        ratios = F.transform("s", lambda p: F.pow(p, alpha) / p)
        return F.array_max(ratios) <= F.lit(float(most_repeats)) * F.array_min(ratios)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    if target_entropy is not None:  # kept at lo, broken at hi: entropy falls as the exponent grows
        step = lambda a, _: F.when(keeps((a["lo"] + a["hi"]) / 2), F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi")))
        found = F.when(keeps(F.lit(1.0)), F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step)["lo"])
    else:  # broken at lo, kept at hi: repeats fall as the exponent grows; the smallest that keeps the limit mixes most
        step = lambda a, _: F.when(keeps((a["lo"] + a["hi"]) / 2), F.struct(a["lo"].alias("lo"), ((a["lo"] + a["hi"]) / 2).alias("hi"))).otherwise(F.struct(((a["lo"] + a["hi"]) / 2).alias("lo"), a["hi"].alias("hi")))
        found = F.when(keeps(F.lit(0.0)), F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step)["hi"])
    found = F.coalesce(found, F.lit(1.0))
    return shares.withColumn("alpha", found).select("alpha", total(F.transform("s", lambda p: F.pow(p, F.col("alpha")))).alias("norm"), F.array_min(F.transform("s", lambda p: F.pow(p, F.col("alpha")) / p)).alias("least"))


def plan(totals: DataFrame, target_entropy: float | None = None, most_repeats: float | None = 4.0, budget_tokens: int | None = None) -> DataFrame:
    """(source, tokens, alpha, weight, budget) for each row of totals (source, tokens)."""
    whole = totals.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    found = exponent(totals, target_entropy, most_repeats).first()  # one row
    share = F.col("tokens").cast("double") / F.lit(float(max(whole, 1)))
    raised = F.pow(share, F.lit(found["alpha"]))
    weight = F.when(F.col("tokens") > 0, raised / F.lit(found["norm"])).otherwise(0.0)
    budget = F.lit(float(budget_tokens)) * weight if budget_tokens is not None else F.lit(float(whole)) * raised / F.lit(found["least"])
    # a hair less, so that rounding does not start one more pass over a source that needs exactly one
    budget = F.when(F.col("tokens") > 0, F.ceil(budget - 1e-6)).otherwise(0).cast("long")
    return totals.select("source", "tokens", F.lit(found["alpha"]).alias("alpha"), weight.alias("weight"), budget.alias("budget"))


def fraction(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to below 1, in the order of ``shiftrightunsigned(h, 1)``."""
    return F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(1 << 52))


def before(keys: list[str], order: list[Column | str], amount: str) -> Column:
    """The sum of ``amount`` over what comes earlier among rows of the same keys."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0))


def mix(docs: DataFrame, target_entropy: float | None = None, most_repeats: float | None = 4.0, budget_tokens: int | None = None, block_tokens: int = 200_000, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, place): each placing of a document; place is the number of its source's tokens before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens_of(F.col("text")).alias("tokens"))
    rows = cut(rows)  # a few bytes a document; the texts are read once
    totals = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    sources = plan(totals, target_entropy, most_repeats, budget_tokens)
    # Spark broadcasts this side if it is small and splits the hot sources of the other if it is not
    own = sources.select(F.col("source").alias("own"), F.col("tokens").alias("total"), "weight", "budget")
    dealt = rows.join(own, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    per = F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("long")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), per)).withColumn("groups", F.ceil(per / GROUP))
    kept = [F.first(c).alias(c) for c in ("total", "budget", "groups")]
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"), *kept)
    passes = F.coalesce(F.try_divide(F.col("budget").cast("double"), F.col("total")), F.lit(1.0))
    epochs = F.greatest(F.lit(1), F.ceil(passes)).cast("int")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "block")).withColumn("group", F.floor(fraction(F.col("h")) * F.col("groups")))
    groups = blocks.groupBy("source", "epoch", "group").agg(F.sum("in_block").alias("in_group"))
    groups = groups.withColumn("group_before", before(["source", "epoch"], ["group"], "in_group"))
    groups = groups.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("group").alias("g"), "group_before")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("group") == F.col("g"))
    blocks = blocks.join(groups, same).drop("s", "e", "g")
    order = [F.shiftrightunsigned("h", 1), F.col("block")]
    in_group = before(["source", "epoch", "group"], order, "in_block")
    blocks = blocks.withColumn("before", F.col("epoch") * F.col("total") + F.col("group_before") + in_group)
    whole_pass = (F.col("epoch") == 0) & (F.col("budget") >= F.col("total"))
    used = blocks.where((F.col("before") < F.col("budget")) | whole_pass).select(F.col("source").alias("s"), F.col("block").alias("k"), "epoch", "before")
    placed = dealt.join(used, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).drop("s", "k")
    inside = before(["source", "block", "epoch"], [F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.col("doc_id"), F.col("tokens")], "tokens")
    placed = placed.withColumn("place", F.col("before") + inside).where((F.col("place") < F.col("budget")) | whole_pass)
    return placed.select("doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", "epoch", "block", "place")
