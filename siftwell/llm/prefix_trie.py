"""Operator 12: the trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Turns are numbered
and their position-tagged hashes are summed up (by exclusive or, 120 bits) along each conversation in range partitions,
each of which passes on where its last conversation stands, so no conversation has to fit in a task. Equal sums at equal
depths are equal prefixes, so nodes and members come from one aggregation.

A node is named by its smallest member and its depth. What a conversation owns are the nodes named by it, the lower end
of its path; so the number of nodes below a node is a plain sum over its members, which gives centroids without a walk.

Rollup: of each component the centroid is taken, the lowest node that has half of the component's nodes at or below it.
The totals of what hangs at the centroid are added along the path from it to the component's top. Without the centroid
the component falls into those below it and the rest, each with half of the nodes at most, which are split in the same
way. Components above SPLIT_NODES are split by joins (one round halves them all); smaller ones are packed into tasks,
where all components of a pack are split at once, level by level.

Defined results: null roles and texts are empty; rows without conv_id belong to no conversation; turns of one
conversation with the same number are ordered by role, then text; repeated rows are repeated turns; an empty table has
no nodes, not even a root; other columns may have any names. The digest of a node's ends needs them in one stream: ids
are joined to strings of bounded length first, which then pass one after the other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siftwell.llm.common import table, word_array
from siftwell.session import cut_lineage

SPLIT_NODES = 1 << 14  # components up to this size are split inside a task
SHARED_BLOCK, MOST_SHARED = 20, 4  # conversations of a block may share the first 0..3 turns of its first one
CHUNK_BYTES = 1 << 16


def along_runs(df: DataFrame, by: str, order: Sequence[Column], keep: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """by, keep, _n (number of a row among those of its by, from 1) and, in place of each column of xors, its running
    exclusive or. Rows are dealt by ranges of (by, order), so a by may go through many partitions; each partition tells
    the later ones where it stopped, one row per partition. by has no nulls."""
    dealt = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).select(by, *keep, *xors)
    long = [T.StructField(c, T.LongType()) for c in ("_n", "_part")]
    schema = T.StructType([dealt.schema[c] for c in (by, *keep, *xors)] + long)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, count, states = None, 0, np.zeros(len(xors), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(by).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            goes_on = now is not None and ids[0] == now
            n = np.arange(len(ids)) - starts[which] + 1 + np.where(which == 0, count * goes_on, 0)
            columns = []
            for i, name in enumerate(xors):
                values = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.bitwise_xor.accumulate(values)
                before = np.concatenate([[0], total])[starts]
                before[0] = states[i] if goes_on else 0
                columns.append(total ^ before[which])
            now, count, states = ids[-1], int(n[-1]), np.array([c[-1] for c in columns], np.int64)
            arrays = [*(batch.column(c) for c in (by, *keep)), *map(pa.array, columns), pa.array(n), pa.array(np.full(len(ids), part))]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    local = cut_lineage(dealt.mapInArrow(scan, schema))
    states = ["_n", *xors]
    ends = local.groupBy("_part").agg(
        F.min(by).alias("first"), F.max_by(F.struct(by, *states), F.struct(by, "_n")).alias("last")
    )
    head = ends.select("_part", F.lit(0).alias("_is_end"), F.col("first").alias(by), *(F.lit(0).cast("long").alias(c) for c in states))
    tail = ends.select("_part", F.lit(1).alias("_is_end"), "last.*")
    earlier = W.partitionBy(by).orderBy("_part", "_is_end").rowsBetween(W.unboundedPreceding, -1)
    carried = [F.sum("_n").over(earlier).alias("_more_n"), *(F.bit_xor(c).over(earlier).alias(f"_more{c}") for c in xors)]
    carry = head.unionByName(tail).select("_part", "_is_end", by, *carried).where("_is_end = 0 AND _more_n > 0").drop("_is_end")
    placed = local.join(F.broadcast(carry), ["_part", by], "left")  # at most one row per partition
    running = [F.col(c).bitwiseXOR(F.coalesce(F.col(f"_more{c}"), F.lit(0))).alias(c) for c in xors]
    return placed.select(by, *keep, *running, (F.col("_n") + F.coalesce("_more_n", F.lit(0))).alias("_n"))


def _sixty_bits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, n (1.. in the order of the conversation), content (digest of role and text), words (of the text)."""
    said = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = said.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", "_role", "_text",
        F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text")).alias("content"),
        F.size(word_array(F.col("_text"))).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    return along_runs(rows, "conv_id", order, ["content", "words"]).withColumnRenamed("_n", "n")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, n, content, words) and conversations (conv_id, length): each begins with the first h
    turns of the first conversation of its block and goes on with its own turns behind its first h."""
    base = F.col("conv_id") - F.col("conv_id") % SHARED_BLOCK
    shared = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    heads = turns.where(F.col("n") < MOST_SHARED).groupBy(F.col("conv_id").alias("_base")).agg(
        F.array_sort(F.collect_list(F.struct("n", "content", "words"))).alias("_head")  # three turns at most
    )
    sizes = turns.groupBy("conv_id").agg(F.max("n").alias("_own")).select("*", base.alias("_base"), shared.cast("int").alias("_h"))
    head = F.slice(F.coalesce("_head", F.array().cast("array<struct<n:bigint,content:string,words:bigint>>")), 1, F.col("_h"))
    convs = cut_lineage(sizes.join(heads, "_base", "left").select("conv_id", "_own", "_h", head.alias("_head")))
    own = turns.join(convs.select("conv_id", "_h", F.size("_head").alias("_got")), "conv_id").where("n > _h")
    rebuilt = own.select("conv_id", (F.col("n") - F.col("_h") + F.col("_got")).alias("n"), "content", "words").unionByName(
        convs.select("conv_id", F.inline("_head"))
    )
    length = F.size("_head") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))
    return rebuilt, convs.select("conv_id", length.cast("long").alias("length"))


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(conv_id, depth, parent_conv_id, n_convs, words, k1, k2) and paths(member, depth, conv_id, parent_conv_id): the
    node of every member at every depth. turns: conv_id, n (1.. without gaps), content, words; convs: conv_id, length."""
    digest = F.md5(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("content")))
    hashed = turns.select("conv_id", F.col("n").alias("depth"), "words", _sixty_bits(digest, 1).alias("k1"), _sixty_bits(digest, 17).alias("k2"))
    own = [F.col("k1").alias("e1"), F.col("k2").alias("e2")]
    keyed = along_runs(hashed.select("*", *own), "conv_id", [F.col("depth")], ["depth", "words", "e1", "e2"], ["k1", "k2"]).drop("_n")
    up = [F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2")]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("words"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    rows = cut_lineage(keyed.select("conv_id", "depth", "words", "k1", "k2", *up).unionByName(root))
    key = ["depth", "k1", "k2"]
    bare = cut_lineage(rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    ))
    parents = bare.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(bare.join(parents, ["depth", "p1", "p2"], "left").drop("p1", "p2"))
    members = rows.select(F.col("conv_id").alias("member"), *key)
    return nodes, cut_lineage(members.join(nodes.select(*key, "conv_id", "parent_conv_id"), key).drop("k1", "k2"))


def subtree_sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes + size: how many nodes are at or below each. Members other than the one that names a node own only nodes
    below it; the naming one owns those from the node's depth on."""
    owned = paths.groupBy("member").agg(F.count_if(F.col("member") == F.col("conv_id")).alias("_owned"), F.max("depth").alias("_deepest"))
    through = paths.join(owned, "member").groupBy("conv_id", "depth").agg(
        F.sum(F.when(F.col("member") == F.col("conv_id"), F.col("_deepest") - F.col("depth") + 1).otherwise(F.col("_owned"))).alias("size")
    )
    return nodes.join(through, ["conv_id", "depth"])


def decompose(parent: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over each node's subtree, for a forest whose nodes are ordered by tree and then by depth.
    parent: index of each node's parent, -1 for a top; size: nodes at or below each node; values: a column per sum."""
    n = len(parent)
    parent, size, sums = parent.copy(), size.copy(), np.zeros_like(values)
    # preorder numbers: a node's subtree is an interval of them
    order = np.lexsort((np.arange(n), parent))
    before = np.cumsum(size[order]) - size[order]
    first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]])
    offset = np.empty(n, np.int64)
    offset[order] = before - before[np.flatnonzero(first)][np.cumsum(first) - 1]
    number = np.where(parent < 0, offset, 0)
    by_depth = np.argsort(depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        level = level[parent[level] >= 0]
        number[level] = number[parent[level]] + 1 + offset[level]
    last = number + size
    tops = np.flatnonzero(parent < 0)
    comp = tops[np.searchsorted(tops, np.arange(n), "right") - 1]  # the top of each node's component
    live = np.arange(n)
    while len(live):
        halves = live[2 * size[live] >= size[comp[live]]]  # of a component they are a path
        centroid = np.full(n, -1, np.int64)
        np.maximum.at(centroid, comp[halves], halves)  # its lowest node comes last
        own = centroid[comp[live]]
        below = (number[live] > number[own]) & (number[live] < last[own])
        total = np.zeros_like(values)
        part = below | (live == own)
        np.add.at(total, own[part], values[live[part]])
        found = np.unique(own)
        at, carried, gone = found, total[found], size[found].copy()
        while len(at):  # from each centroid to the top of its component
            sums[at] += carried
            size[at] -= gone
            up = parent[at] >= 0
            at, carried, gone = parent[at][up], carried[up], gone[up]
        # below a centroid each child is the top of a new component
        heads = live[below & (parent[live] == own)]
        keys = np.sort(comp[heads] * (n + 1) + number[heads])
        by_key = heads[np.argsort(comp[heads] * (n + 1) + number[heads])]
        moved = live[below]
        comp[moved] = by_key[np.searchsorted(keys, comp[moved] * (n + 1) + number[moved], "right") - 1]
        parent[heads] = -1
        live = live[live != own]
    return sums


def _small_components(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """conv_id, depth and the sums of values for nodes of components of at most SPLIT_NODES: whole components lie side
    by side in a partition; some of them at a time, SPLIT_NODES nodes or a little more, are split as one forest."""
    columns = ["conv_id", "depth", "parent_conv_id", "top_conv_id", "top_depth", "size", *values]
    dealt = nodes.select(*columns).repartition("top_conv_id", "top_depth").sortWithinPartitions("top_conv_id", "top_depth", "depth", "conv_id")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("conv_id", "depth", *values)])

    def solve(held: list[np.ndarray]) -> pa.RecordBatch:
        conv, depth, above, top_conv, top_depth, size, *rest = np.concatenate(held, axis=1)
        tree = np.cumsum(np.concatenate([[True], (top_conv[1:] != top_conv[:-1]) | (top_depth[1:] != top_depth[:-1])]))
        is_top = (conv == top_conv) & (depth == top_depth)
        names, code = np.unique(np.concatenate([conv, above]), return_inverse=True)
        span = int(depth.max()) + 2
        place = (tree * span + depth) * len(names) + code[: len(conv)]  # ascending: rows are ordered by tree, depth, conv_id
        parent = np.searchsorted(place, (tree * span + depth - 1) * len(names) + code[len(conv) :])
        sums = decompose(np.where(is_top, -1, parent), depth, size, np.stack(rest, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (conv, depth, *sums.T)], schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            # the root's parent is null; as a top it is never looked up
            block = np.stack([batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in columns])
            held.append(block)
            rows += block.shape[1]
            if rows > SPLIT_NODES:
                whole = np.concatenate(held, axis=1)
                cut = np.flatnonzero((whole[3] != whole[3, -1]) | (whole[4] != whole[4, -1]))
                end = int(cut[-1]) + 1 if len(cut) else 0  # the last component may go on
                if end:
                    yield solve([whole[:, :end]])
                held, rows = [whole[:, end:]], whole.shape[1] - end
        if rows:
            yield solve(held)

    return dealt.mapInArrow(run, schema)


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], split_nodes: int = SPLIT_NODES) -> DataFrame:
    """conv_id, depth and, for each column of values, its sum over the node's subtree. nodes has size (subtree_sizes)."""
    top = ["top_conv_id", "top_depth"]
    root = nodes.where("depth = 0").agg(F.min("conv_id").alias("top_conv_id"))
    first = {"top_conv_id": root.scalar(), "top_depth": F.lit(0).cast("long")}
    state = nodes.select("conv_id", "depth", "parent_conv_id", "size", *values).withColumns(first)
    parts: list[DataFrame] = []
    is_top = (F.col("conv_id") == F.col("top_conv_id")) & (F.col("depth") == F.col("top_depth"))
    while True:
        state = cut_lineage(state)
        totals = state.where(is_top).select(*top, F.col("size").alias("total"))
        sized = cut_lineage(state.join(totals, top))
        parts.append(_small_components(sized.where(F.col("total") <= split_nodes), values))
        state = sized.where(F.col("total") > split_nodes)
        if state.isEmpty():
            break
        # the lowest node with half of its component
        best = F.min_by(F.struct(F.col("conv_id").alias("x_conv_id"), F.col("depth").alias("x_depth"), F.col("size").alias("x_size")), "size")
        centroids = cut_lineage(state.where(F.col("size") * 2 >= F.col("total")).groupBy(*top).agg(best.alias("x")).select(*top, "x.*"))
        step = paths.select(F.col("member").alias("_m"), F.col("depth").alias("_d"), F.col("conv_id").alias("_o"), F.col("parent_conv_id").alias("_po"))
        marked = state.join(centroids, top)
        under = (F.col("conv_id") == F.col("_m")) & (F.col("_d") == F.col("x_depth") + 1) & (F.col("depth") > F.col("x_depth"))
        below, is_x = F.col("_po") == F.col("x_conv_id"), (F.col("conv_id") == F.col("x_conv_id")) & (F.col("depth") == F.col("x_depth"))
        marked = cut_lineage(marked.join(step, under, "left").withColumns({"below": F.coalesce(below, F.lit(False)), "is_x": is_x}))
        gathered = marked.where("below OR is_x").groupBy(*top).agg(*(F.sum(c).alias(c) for c in values))
        between = (F.col("_m") == F.col("x_conv_id")) & F.col("_d").between(F.col("top_depth"), F.col("x_depth"))
        path = cut_lineage(centroids.join(step, between).select(*top, F.col("_o").alias("conv_id"), F.col("_d").alias("depth"), F.col("x_size").alias("gone")))
        parts.append(path.join(gathered, top).select("conv_id", "depth", *values))
        rest = marked.where("NOT is_x").join(path.select("conv_id", "depth", *top, "gone"), ["conv_id", "depth", *top], "left")
        state = rest.select(
            "conv_id", "depth", "parent_conv_id", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size"), *values,
            F.when(F.col("below"), F.col("_o")).otherwise(F.col("top_conv_id")).alias("top_conv_id"),
            F.when(F.col("below"), F.col("x_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
    return reduce(DataFrame.unionByName, parts).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in values))


def end_digests(ends: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, ends_sha256: SHA-256 of the key's conv_ids, ascending and joined by commas. ends: key, conv_id, no nulls."""
    key = list(key)
    dealt = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    longs = [T.StructField(c, T.LongType()) for c in (*key, "first")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key])
            ids = batch.column("conv_id").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if ids else []
            pieces = [(a, b) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True) for a in range(s, e, CHUNK_BYTES // 20) for b in [min(e, a + CHUNK_BYTES // 20)]]
            texts = [",".join(map(str, ids[a:b])) for a, b in pieces]
            at = [a for a, _ in pieces]
            arrays = [*(pa.array(k[at]) for k in keys), pa.array([ids[a] for a in at], pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*key, "first", "joined"])

    joined = dealt.mapInArrow(join, T.StructType([*longs, T.StructField("joined", T.StringType())]))
    streams = joined.repartition(*key).sortWithinPartitions(*key, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *k, text in zip(*(batch.column(c).to_pylist() for c in (*key, "joined")), strict=True):
                if k == now:
                    state.update(b"," + text.encode())
                    continue
                done += [(*now, state.hexdigest())] if state else []
                now, state = k, hashlib.sha256(text.encode())
            yield rows(done)
        yield rows([(*now, state.hexdigest())] if state else [])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * (len(key) + 1)
        types = [pa.int64()] * len(key) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [*key, "ends_sha256"])

    return streams.mapInArrow(digest, T.StructType([*longs[:-1], T.StructField("ends_sha256", T.StringType())]))


def prefix_trie(turns: DataFrame, convs: DataFrame, split_nodes: int = SPLIT_NODES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, paths = trie(turns, convs)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    })
    valued = cut_lineage(subtree_sizes(valued, paths))
    sums = rollup(valued, paths, ["n_leaves", "saved_tokens"], split_nodes)
    last = paths.join(convs.select(F.col("conv_id").alias("member"), F.col("length").alias("depth")), ["member", "depth"])
    digests = end_digests(last.select(F.col("conv_id").alias("node"), "depth", F.col("member").alias("conv_id")), ["node", "depth"])
    rows = valued.drop("n_leaves", "saved_tokens", "size").join(sums, ["conv_id", "depth"])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(digests.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that some share their first turns."""
    turns, convs = with_shared_heads(turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, convs)


# what conversations say in SQL; crc32 bit by bit (fixed value: its polynomial)
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda acc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(acc, b)),
             4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT c.conv_id, t.n, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.n <= c.h),
got AS (SELECT conv_id, count(*) AS got FROM heads GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.n - c.h + coalesce(g.got, 0), t.role, t.text
  FROM turns t JOIN convs c USING (conv_id) LEFT JOIN got g USING (conv_id) WHERE t.n > c.h),
paths AS (
  SELECT conv_id, n AS depth, text,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY n)) AS key
  FROM rebuilt UNION ALL SELECT conv_id, 0, '', '' FROM convs),
nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS saved
  FROM paths GROUP BY depth, key),
linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id, p.key AS parent_key
  FROM nodes c LEFT JOIN paths u ON u.conv_id = c.conv_id AND u.depth = c.depth - 1
  LEFT JOIN nodes p ON p.depth = u.depth AND p.key = u.key),
counted AS (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children
  FROM linked l LEFT JOIN (
    SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL) k USING (depth, key)),
sums AS (
  SELECT a.depth, a.key, count(*) FILTER (c.n_children = 0) AS n_leaves, sum(c.saved)::BIGINT AS saved_tokens
  FROM counted c JOIN paths a ON a.conv_id = c.conv_id AND a.depth <= c.depth GROUP BY a.depth, a.key),
ends AS (
  SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM paths GROUP BY conv_id) GROUP BY depth, key)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN sums s USING (depth, key) LEFT JOIN ends e USING (depth, key)
"""
