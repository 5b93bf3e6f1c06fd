"""Dependency trees as parent-pointer rows: tokens(msg_id, sent_no, tok_no, head, rel), head 0 for the root.

Trees of up to WHOLE nodes are walked inside tasks, many at a time. In larger ones all joins are on (tree, node), which is
unique on one side, so a tree of any size is spread over the tasks; AQE splits the children of a node with very many."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import cut_lineage

TREE = ("msg_id", "sent_no")
WHOLE = 10_000  # nodes of a tree that a task holds at once


def _levels(tree: np.ndarray, node: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes of whole trees, by number of the tree: whether they hang on the root, their level, and whether their
    tree has a node twice."""
    n = len(tree)
    names, number = np.unique(np.concatenate([node, head]), return_inverse=True)
    own, above = tree * len(names) + number[:n], tree * len(names) + number[n:]
    order = np.argsort(own, kind="stable")
    sorted_ = own[order]
    twice = np.isin(tree, tree[order[1:][sorted_[1:] == sorted_[:-1]]])
    at = np.minimum(np.searchsorted(sorted_, above), n - 1)
    is_top = head == 0
    up = np.append(np.where(is_top, np.arange(n), np.where(sorted_[at] == above, order[at], n)), n)  # n: no such node
    level = np.append(np.where(is_top, 0, 1), 0)
    for _ in range(n.bit_length() + 1):
        higher = up[up]
        if np.array_equal(higher, up):
            break
        level, up = level + level[up], higher
    tops = np.flatnonzero(is_top)
    tops = tops[np.lexsort((node[tops], tree[tops]))]
    is_root = np.zeros(n + 1, bool)
    is_root[tops[np.append(tree[tops][1:] != tree[tops][:-1], True)[: len(tops)]]] = True  # the last top of each tree
    return is_root[up[:n]], level[:n], twice


def _walk(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reachable nodes with level of trees that a task can hold, _done; nodes of trees that have a node twice or one without
    a number come back as they are, not _done."""
    keys = list(keys)
    rows = tokens.repartition(*keys).sortWithinPartitions(*keys)

    def starts(rows: pa.Table) -> np.ndarray:
        changes = (pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in map(rows.column, keys))
        return np.append(True, reduce(np.logical_or, (c.to_numpy() for c in changes)))

    def walked(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        tree = np.cumsum(first)
        node, head = (pc.fill_null(rows.column(c), 0).to_numpy().astype(np.int64) for c in ("tok_no", "head"))
        hangs, level, odd = _levels(tree, node, head)
        odd |= np.isin(tree, tree[pc.is_null(rows.column("tok_no")).to_numpy()])
        out = rows.append_column("level", pa.array(level, pa.int32())).append_column("_done", pa.array(~odd))
        yield from out.filter(pa.array(hangs | odd)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tree may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if rows.num_rows:
                first = starts(rows)
                last = int(np.flatnonzero(first)[-1])
                if last:
                    yield from walked(rows.slice(0, last), first[:last])
                held = rows.slice(last)
        if held is not None:
            yield from walked(held, starts(held))

    types = {f.name: f.dataType.simpleString() for f in tokens.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", level int, _done boolean")


def reachable_nodes(tokens: DataFrame, tree: Sequence[str] = TREE) -> DataFrame:
    """Nodes that hang on the root of their tree, with level (root 0). If several words have head 0 the last is the
    root; the others, their subtrees, cycles and children of missing words are left out, and so are rows whose tree or head
    is null. Trees of up to WHOLE nodes are walked inside tasks; what remains goes through joins."""
    keys = list(tree)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "head"]])
    tokens = cut_lineage(tokens.where(known).select(*keys, "tok_no", "head", "rel"))
    large = cut_lineage(tokens.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).drop("_n"))
    small, rest = tokens, []
    if not large.isEmpty():
        small, rest = tokens.join(large, keys, "left_anti"), [tokens.join(large, keys, "left_semi")]
    walked = cut_lineage(_walk(small, keys))
    out, odd = walked.where("_done").drop("_done"), walked.where("NOT _done").select(*tokens.columns)
    rest += [] if odd.isEmpty() else [odd]
    return reduce(DataFrame.unionByName, [_by_joins(r, keys) for r in rest], out)


def _by_joins(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """reachable_nodes of trees of any size.

    Pointers are doubled: after round r every open node points 2**r steps up, so the number of rounds is the logarithm
    of the depth. A round reads all nodes but writes open ones only, to the shared folder; nodes that have reached the
    top are never written again."""
    is_top = F.col("head") == 0
    roots = tokens.where(is_top).groupBy(*keys).agg(F.max("tok_no").alias("tok_no")).withColumn("_alive", F.lit(True))
    tops = tokens.where(is_top).join(roots, [*keys, "tok_no"], "left")
    start = tops.unionByName(tokens.where(~is_top).withColumn("_alive", F.lit(None).cast("boolean")))
    first = cut_lineage(
        start.select(
            *keys, "tok_no", "head", "rel",
            F.when(is_top, F.col("tok_no")).otherwise(F.col("head")).alias("_up"),
            F.when(is_top, 0).otherwise(1).alias("level"),
            (~is_top).alias("_open"),
            F.coalesce("_alive", F.lit(False)).alias("_alive"),
        )
    )
    closed, open_ = first.where("NOT _open"), first.where("_open")
    longest = first.agg(F.max("tok_no")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest + 1)) + 1):
        if open_.isEmpty():
            break
        target = closed.unionByName(open_).select(
            *keys, F.col("tok_no").alias("_up"), F.col("_up").alias("_up2"), F.col("level").alias("_level2"),
            F.col("_open").alias("_open2"), F.col("_alive").alias("_alive2"),
        )
        moved = cut_lineage(
            open_.join(target, [*keys, "_up"]).select(
                *keys, "tok_no", "head", "rel", F.col("_up2").alias("_up"), (F.col("level") + F.col("_level2")).alias("level"),
                F.col("_open2").alias("_open"), F.col("_alive2").alias("_alive"),
            )
        )
        closed, open_ = closed.unionByName(moved.where("NOT _open")), moved.where("_open")
    return closed.where("_alive").drop("_up", "_open", "_alive")


def tree_depths(nodes: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Height of the tallest tree of a message; a single word has height 1."""
    return nodes.groupBy(id_col).agg((F.max("level") + 1).alias("depth"))


def most_children(nodes: DataFrame, tree: Sequence[str] = TREE, id_col: str = "msg_id") -> DataFrame:
    """Largest number of children of any node."""
    per_node = nodes.groupBy(*tree, "head").agg(F.count_if(F.col("head") > 0).alias("_n"))
    return per_node.groupBy(id_col).agg(F.max("_n").alias("most_children"))


def relation_kinds(nodes: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Number of different relation tags."""
    return nodes.groupBy(id_col).agg(F.count_distinct("rel").alias("n_relations"))


def tree_shape(nodes: DataFrame, tree: Sequence[str] = TREE, id_col: str = "msg_id") -> DataFrame:
    """(msg_id, depth, most_children, n_relations)."""
    return (
        tree_depths(nodes, id_col)
        .join(most_children(nodes, tree, id_col), id_col)
        .join(relation_kinds(nodes, id_col), id_col)
    )


def path_ngrams(nodes: DataFrame, tree: Sequence[str] = TREE) -> DataFrame:
    """(msg_id, sent_no, term) for the relation tags on every downward path of 1, 2 and 3 nodes."""
    keys = list(tree)

    def above(step: str) -> DataFrame:
        return nodes.select(
            *keys, F.col("tok_no").alias(f"_{step}"), F.col("rel").alias(f"_{step}_rel"), F.col("head").alias(f"_{step}_head")
        )

    parent = nodes.select(*keys, "rel", F.col("head").alias("_p")).join(above("p"), [*keys, "_p"], "left")
    grand = parent.withColumn("_g", F.col("_p_head")).join(above("g"), [*keys, "_g"], "left")
    two = F.concat_ws(" ", "_p_rel", "rel")
    three = F.concat_ws(" ", "_g_rel", "_p_rel", "rel")
    terms = F.array(
        F.col("rel"), F.when(F.col("_p_rel").isNotNull(), two), F.when(F.col("_g_rel").isNotNull(), three)
    )
    return grand.select(*keys, F.explode(terms).alias("term")).where(F.col("term").isNotNull())


def path_ngram_counts(paths: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(msg_id, term, n): paths of the message's trees."""
    return paths.groupBy(id_col, "term").agg(F.count("*").alias("n"))


def path_vocabulary(paths: DataFrame, tree: Sequence[str] = TREE) -> DataFrame:
    """(term, n): number of trees that hold the path."""
    return paths.select(*tree, "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
