"""Exact n-gram Jaccard self-join: signature trees inside routed blocks.

1. Each document becomes the set of its hashed k-word shingles. Equal sets are collapsed to one node.
2. Routing. Two sets of similarity t share at least ``l`` of their first ``n - ceil(t n) + l`` tokens in any common
   order. The order of the hashes gives these prefixes; of them only tokens that occur in two nodes' prefixes matter,
   and a node that has fewer than ``l`` such tokens can have no partner. The rest are ordered by how many nodes have
   them, rarest first, and all but the last ``l - 1`` name the node's routes. Nodes that share a route belong to one block
   (connected components), so every link lies inside a block, and passages that many documents share seldom join blocks.
   Tokens that very many nodes have are counted apart with partial sums, and their nodes meet in parts.
3. A block is one chunk, or where it is large cut into chunks by size class and hash, of about ``chunk_tokens`` tokens. Signature trees over the chunks are joined
   by dual traversal: first each chunk with itself and with its classes' first chunks, then the pairs of chunks that are
   not yet all one component. Links found are verified on the whole sets and give the components. Whole sets are made from the
   texts where a task needs them, and never stored.

No pairs of a group are emitted, only the links that span its components or, where links are counted, each set's number of
them; nothing is capped, and no step gathers a block.

Defined cases: null text, or text without words, has the empty set (size 0) and is linked with nothing; fewer than k
words make one shingle of the whole sequence; rows that repeat an id are rows of their own that end in the same result if their
texts are equal; rows without an id are linked like all others, and have no id to give to their component; texts of any length are read whole; of ties
the smallest id names the component; an empty table gives an empty result; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signature_tree
from . import textscan as ts
from .shared import connected_components, cut, side_of_ids

SET = "doc_id long, n long, h1 long, h2 long"


def overlap_of(n: int, num: int, den: int) -> int:
    """The least overlap of a set of size n with any similar set."""
    return -(-num * n // den)


def sure(n: int) -> int:
    """How many common prefix tokens the routing asks for, for a set of size n."""
    return max(1, n // 10)


def text_hash(text: str = "text") -> Column:
    """What identifies a row's text beside its id: null and empty texts are one."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def shingle_sets(docs: DataFrame, k: int, num: int, den: int, whole: bool = False, along: list[str] = ()) -> DataFrame:
    """(doc_id, n, h1, h2, need, tokens): the set's size and two hashes, and its sorted prefix (the whole set if ``whole``). The columns of longs named in ``along`` come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.slices(batch.column(1)):
                starts, ends, counts = ts.word_spans(data, offsets, ts.NOT_SPACE)
                hashes = ts.span_hashes(data, starts, ends)
                n, h1, h2, need, tokens = [], [], [], [], []
                for own in ts.row_runs(hashes, counts, k):
                    own = ts.distinct(own)
                    size = len(own)
                    n.append(size), need.append(sure(overlap_of(size, num, den)))
                    h1.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(ts.mix(own).sum(dtype=np.uint64).view(np.int64)))
                    tokens.append(ts.signed(own if whole else own[: size - overlap_of(size, num, den) + sure(size)]))
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
                at = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
                arrays = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))
                more = [c.slice(lo, hi - lo) for c in batch.columns[2:]]
                names = ["doc_id", "n", "h1", "h2", "need", "tokens", *along]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(need, pa.int32()), arrays, *more], names)

    schema = ", ".join([SET, "need int, tokens array<long>", *(f"{c} long" for c in along)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *along).mapInArrow(run, schema)


#: Nodes of one token that meet in one group; a token with more of them meets in parts whose smallest nodes meet.
PART_NODES = 10_000
#: Tokens that the sketch of frequent ones names, and items that it tracks in each task.
FREQUENT, TRACKED = 1_000, 16_384


def counted_tokens(tokens: DataFrame) -> DataFrame:
    """(node, need, token, df): the tokens (node, need, token) that two nodes or more have, with their number of nodes.

    Tokens that a sketch of bounded size names as frequent (``FREQUENT`` at most, which come to the driver with their counts) are counted by
    partial sums; all others by windows. The counts are exact whatever the sketch names.
    """
    named = tokens.agg(F.expr(f"approx_top_k(token, {FREQUENT}, {TRACKED})").alias("top")).first()["top"]
    often = F.col("token").isin([x["item"] for x in named or () if x["item"] is not None])
    others = tokens.where(~often).withColumn("df", F.count("*").over(Window.partitionBy("token")))
    frequent = tokens.where(often)
    counts = dict(frequent.groupBy("token").count().collect())
    if counts:
        held = F.map_from_arrays(*(F.lit(list(x)).cast("array<bigint>") for x in (counts.keys(), counts.values())))
        others = others.unionByName(frequent.withColumn("df", F.try_element_at(held, F.col("token"))))
    return others.where("df > 1")


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(node, component): nodes that may have links, by block. nodes: (node, need, tokens)."""
    shared = counted_tokens(nodes.select("node", "need", F.explode("tokens").alias("token")))
    rare = shared.groupBy("node").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= F.col("need"))
    routes = rare.select("node", F.explode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("t")).select("node", F.col("t.token").alias("token"), F.col("t.df").alias("df"))
    parts = F.ceil(F.col("df") / PART_NODES)
    routes = routes.select("node", "token", (parts > 1).alias("many"), F.pmod(F.xxhash64("node"), parts).alias("part"))
    met = cut(routes.withColumn("low", F.min("node").over(Window.partitionBy("token", "part"))).where("node > low OR many").select("node", "token", "low", "many").distinct())
    lows = met.where("many").select("token", "low").distinct().withColumn("least", F.min("low").over(Window.partitionBy("token")))
    edges = met.select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(lows.select(F.col("low").alias("a"), F.col("least").alias("b")))
    return connected_components(edges)


#: Gives members (task, side, node, label and what else they have) their column tokens.
Sets = Callable[[DataFrame], DataFrame]


def chunk_links(members: DataFrame, tasks: DataFrame, num: int, den: int, counted: bool = False, sets: Sets | None = None) -> DataFrame:
    """(a, b): links that the tree joins of the tasks (block, c1, c2) find. members: (node, block, chunk, label, tokens or what ``sets`` makes them from).

    ``counted``: instead (node, n), the summed labels of all sets that are similar to the node's in each task.
    """
    left = tasks.select("block", "c1", "c2", F.col("c1").alias("chunk"), F.when(F.col("c1") == F.col("c2"), 2).otherwise(0).alias("side"))
    right = tasks.where("c1 <> c2").select("block", "c1", "c2", F.col("c2").alias("chunk"), F.lit(1).alias("side"))
    rows = members.join(left.unionByName(right), ["block", "chunk"])
    rows = rows.withColumn("task", F.xxhash64("block", "c1", "c2")).withColumn("side", F.col("side").cast("long"))
    rows = (rows if sets is None else sets(rows)).select("task", "side", "node", "label", "tokens")
    names = ["node", "n"] if counted else ["a", "b"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task, many small tasks to a batch; one task's sets are held at a time."""
        now, held = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            task, side, node, label = (batch.column(i).to_numpy() for i in range(4))
            tokens = batch.column(4)
            at, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy()
            for r in range(batch.num_rows):
                if task[r] != now:
                    found += joined(held)
                    now, held = task[r], {}
                held.setdefault(int(node[r]), (side[r], label[r], flat[at[r] : at[r + 1]].copy()))
            yield pairs(found)
        yield pairs(joined(held))
        held.clear()
        pa.default_memory_pool().release_unused()

    def joined(held: dict[int, tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        ids = list(held)
        side, label, own = zip(*held.values(), strict=True)
        if counted:
            n = signature_tree.degrees(list(own), np.array(side), np.array(label), num, den)
            return [(ids[i], int(n[i])) for i in np.flatnonzero(n).tolist()]
        return [(ids[i], ids[j]) for i, j in signature_tree.links(list(own), np.array(side), np.array(label), num, den)]

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(meet, ", ".join(f"{x} long" for x in names))


def all_chunk_pairs(members: DataFrame) -> DataFrame:
    """(block, c1, c2): every chunk with itself and with the later ones of its block whose sets may be similar in size."""
    chunks = members.select("block", "chunk", "class").distinct()
    near = (F.abs(F.col("l.class") - F.col("r.class")) <= 1) & (F.col("l.chunk") <= F.col("r.chunk"))
    met = chunks.alias("l").join(chunks.alias("r"), F.col("l.block") == F.col("r.block")).where(near)
    return met.select("l.block", F.col("l.chunk").alias("c1"), F.col("r.chunk").alias("c2"))


def placed_in_chunks(nodes: DataFrame, num: int, den: int, chunk_tokens: int, whole_blocks: bool = False) -> DataFrame:
    """The nodes (node, block, n, ...) with their size class and chunk: about chunk_tokens tokens of one class by hash. Similar sets lie in the same or neighbouring classes.

    ``whole_blocks``: a block of no more than ``chunk_tokens`` tokens is one class and one chunk, so that each of its sets is sent once.
    """
    size_class = F.floor(F.log("n") / (1.02 * math.log(den / num))).cast("int")
    if whole_blocks:
        sizes = nodes.groupBy("block").agg(F.sum("n").alias("block_tokens"))
        nodes = nodes.join(sizes, "block")
        size_class = F.when(F.col("block_tokens") > chunk_tokens, size_class).otherwise(0)
    nodes = cut(nodes.withColumn("class", size_class).drop("block_tokens"))
    counts = nodes.groupBy("block", "class").agg(F.sum("n").alias("class_tokens"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("class_tokens") / chunk_tokens))
    return nodes.join(counts, ["block", "class"]).withColumn("chunk", F.concat_ws(":", F.lpad("class", 4, "0"), F.lpad(part.cast("string"), 9, "0"))).drop("class_tokens")


def tree_components(members: DataFrame, num: int, den: int, sets: Sets | None = None) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), components (node, component)) of members (node, block, chunk, class, tokens or what ``sets`` makes them from), by tree joins of their chunks."""
    chunks = members.select("block", "chunk", "class").distinct()
    hubs = chunks.groupBy("block", "class").agg(F.min("chunk").alias("hub"))
    near = F.abs(F.col("l.class") - F.col("r.class")) <= 1
    selfs = chunks.select("block", F.col("chunk").alias("c1"), F.col("chunk").alias("c2"))
    to_hub = chunks.alias("l").join(hubs.alias("r"), F.col("l.block") == F.col("r.block")).where(near & (F.col("l.chunk") != F.col("r.hub"))).select("l.block", F.least("l.chunk", "r.hub").alias("c1"), F.greatest("l.chunk", "r.hub").alias("c2"))
    first = cut(selfs.unionByName(to_hub).distinct())
    links = cut(chunk_links(members.withColumn("label", F.col("node")), first, num, den, sets=sets))
    joined = connected_components(links)
    labels = members.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    range_of = labels.groupBy("block", "chunk", "class").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    rest = range_of.alias("l").join(range_of.alias("r"), F.col("l.block") == F.col("r.block")).where(near & (F.col("l.chunk") < F.col("r.chunk")))
    rest = rest.where((F.col("l.low") != F.col("l.high")) | (F.col("r.low") != F.col("r.high")) | (F.col("l.low") != F.col("r.low"))).select("l.block", F.col("l.chunk").alias("c1"), F.col("r.chunk").alias("c2"))
    rest = cut(rest.join(first, ["block", "c1", "c2"], "left_anti"))
    if not rest.isEmpty():
        links = cut(links.unionByName(chunk_links(labels, rest, num, den, sets=sets)))
        joined = connected_components(links)
    return links, joined


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, chunk_tokens: int = 400_000, count_links: bool = False, mark: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked where den * intersection >= num * union of their shingle sets.

    ``count_links`` adds n_links, the number of other rows that the document is linked with, copies included: then all
    similar pairs of different sets are visited (and only counted), where otherwise those inside a component already
    found are passed over. With ``mark`` the row's text_hash and whether its component ``keeps`` it are added: that
    is one row of each component, of the smallest doc_id (nulls last), and every row of the empty set.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    rows = cut(shingle_sets(docs, k, num, den, along=["text_hash"]).withColumn("row", F.monotonically_increasing_id()))
    key = ["h1", "h2", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("m")
    equal = rows.where("n > 0").groupBy(*key).agg(first, F.count("*").alias("copies"))
    equal = cut(equal.select(*key, F.col("m.doc_id").alias("first"), F.col("m.row").alias("node"), "copies"))
    nodes = rows.join(side_of_ids(equal.select(F.col("node").alias("row"))), "row", "left_semi").withColumnRenamed("row", "node")
    blocks = blocks_of(nodes.select("node", "need", "tokens"))
    placed = blocks.withColumnRenamed("component", "block").join(nodes.select("node", "n", "doc_id", "text_hash"), "node")
    members = placed_in_chunks(placed, num, den, chunk_tokens, whole_blocks=True)
    members = cut(members.select("node", "block", "chunk", "class", "doc_id", "text_hash"))
    wanted = docs.join(side_of_ids(cut(members.select("text_hash").distinct())), "text_hash", "left_semi")

    def sets(tasks: DataFrame) -> DataFrame:
        """Each row's whole set, made from its text again."""
        same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.text_hash") == F.col("t.text_hash"))
        found = wanted.alias("d").join(tasks.alias("t"), same).select("d.doc_id", "d.text", "task", "side", "node", "label")
        return shingle_sets(found, k, num, den, whole=True, along=["task", "side", "node", "label"])

    joined = tree_components(members, num, den, sets)[1]
    of_node = equal.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = F.min(F.struct(F.col("first").isNull().alias("no"), "first", "node")).alias("best")
    least = of_node.groupBy("component").agg(best).select("component", F.col("best.first").alias("component_id"), F.col("best.node").alias("best"))
    named = of_node.join(least, "component").select("node", *key, "component_id", "copies", "best")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = ["doc_id", F.col("n").alias("n_shingles"), component]
    if count_links:
        weighed = members.join(equal.select("node", F.col("copies").alias("label")), "node")
        counted = chunk_links(weighed, all_chunk_pairs(members), num, den, counted=True, sets=sets).groupBy("node").agg(F.sum("n").alias("others"))
        named = named.join(counted, "node", "left")
        links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
        out.append(links.alias("n_links"))
    if mark:
        out += ["text_hash", F.when(F.col("n") > 0, F.col("row") == F.col("best")).otherwise(True).alias("keeps")]
    return rows.select("doc_id", *key, "row", "text_hash").join(named.drop("node"), key, "left").select(*out)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, one with the smallest id, with all its columns.

    Rows are judged each by its own text, and known by id and a hash of the text: of rows that repeat an id, those that resemble nothing stay.
    Where the row to keep is repeated as it is or with other values beside its text, one of them stays. Null ids come
    after all others; documents without words stay, all of them; an empty table stays empty; columns of any name are kept.
    """
    found = components(docs, mark=True, **options).where("n_shingles > 0").withColumnRenamed("text_hash", "mark")
    found = cut(found.groupBy("doc_id", "mark").agg(F.bool_or("keeps").alias("keeps"), F.count("*").alias("rows")).where("NOT keeps OR rows > 1"))
    names = {c: F.col(f"d.`{c}`") for c in docs.columns}

    def of(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (text_hash("d.text") == F.col("k.mark"))
        return rows.alias("d").join(side_of_ids(keys).alias("k"), same, how)

    repeated = found.where("keeps")
    out = of(docs, found, "left_anti").select(list(names.values()))
    if repeated.isEmpty():
        return out
    one = F.min_by(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(names.values())]), F.xxhash64(*[names[c] for c, kind in docs.dtypes if "map<" not in kind])).alias("one")
    single = of(docs, repeated, "inner").groupBy("k.doc_id", "k.mark").agg(one)
    return out.unionByName(single.select(*[F.col(f"one.c{i}").alias(c) for i, c in enumerate(names)]))
