"""Operator 3: near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct 5-word shingles (ASCII lower case). Two permutations make the whole signature: the
first spreads the shingles over the circle of 32-bit numbers, the second is shifted by one place for each coordinate.
BANDS bands of ROWS coordinates name the buckets; two sets that share 3/4 miss each other in all of them with a
probability below 3e-7. What shares a bucket is then decided on whole sets:

1. Documents with equal sets are one node. Nodes that share no bucket have no links.
2. Shingles that no other node in a bucket has cannot be shared, which bounds the overlap of a node from above. Nodes that
   cannot reach 3/4 with anything are done.
3. Each bucket has a hub, the node with the smallest part of such shingles. Members are verified against hubs only, and
   verified links are merged into classes, so a group of n copies costs about n comparisons.
4. Nodes of a bucket that are not in its largest class are compared with all others of the bucket, block by block, as
   products of 0/1 matrices inside tasks of bounded size. Only links leave the tasks, and are merged.

So pairs are never rows, nothing is capped, and every link between candidates counts. Hot sets, buckets, hubs and classes are salted in all joins by their exact numbers of rows.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and keep themselves; a text of
one to four words is one shingle. Repeated rows are copies. component_id is the smallest id of the class (null if no row
of it has one); kept is true where doc_id equals it, both null included. Empty tables give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import WORD, slices, table
from siftwell.operators.skew import HOT, hot_join
from siftwell.session import cut_lineage

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 40
ASK_SHINGLES, MEMBER_SHINGLES = 100_000, 400_000  # of a block of a bucket, about
ASK_NODES, MEMBER_NODES = 2_000, 4_000  # the same in nodes
ASK_SLICE, MEMBER_SLICE = 500, 4_000  # of a tile, at most
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CACHE_WORDS = 500_000


def _mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


class Shingles:
    """64-bit hashes of shingles; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        for word in set(words) - self.known.keys():
            self.known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of all texts, sorted within each, one text after the other, and where each text ends (with a
        leading 0)."""
        rows = [text.encode().translate(_LOWER).split() for text in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        words = self._words([w for row in rows for w in row])
        owner = np.repeat(np.arange(len(rows)), sizes)
        if len(words) >= SHINGLE:
            ends = len(words) - SHINGLE + 1
            hashes = words[:ends]
            for j in range(1, SHINGLE):
                hashes = _mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + words[j : ends + j])
            inside = owner[:ends] == owner[SHINGLE - 1 :]
            hashes, owner = hashes[inside], owner[:ends][inside]
        else:
            hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(rows[i]), seed=1) for i in short], np.uint64)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int64)


def band_hashes(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket names for each non-empty set."""
    starts = ends[:-1][np.diff(ends) > 0]
    circle = (_mix64(hashes) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    names = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(starts), band, np.uint64)
        for row in range(ROWS):
            shifted = _mix32(circle + np.uint32(band * ROWS + row))  # the second one, shifted
            name = _mix64(name * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(shifted, starts).astype(np.uint64))
        names[:, band] = name
    return names


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, _row, n (size of the set), set (digest), bands array<long> of rows (doc_id, _row, _text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for piece in slices(batches, "_text", 1 << 20):
            hashes, ends = shingles.sets(piece.column("_text").to_pylist())
            sizes = np.diff(ends)
            bands = np.zeros((len(sizes), BANDS), np.uint64)
            if len(hashes):
                bands[sizes > 0] = band_hashes(hashes, ends)
            digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            flat = pa.array(bands.reshape(-1).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
            arrays = [piece.column("doc_id"), piece.column("_row"), pa.array(sizes), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "_row", "n", "set", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, _row bigint, n bigint, set binary, bands array<bigint>")


def whole_sets(rows: DataFrame) -> DataFrame:
    """id, n, set (digest), shingles array<long> of rows (id, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for piece in slices(batches, "_text", 1 << 20):
            hashes, ends = shingles.sets(piece.column("_text").to_pylist())
            digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
            arrays = [piece.column("id"), pa.array(np.diff(ends)), pa.array(digests, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "set", "shingles"])

    return rows.mapInArrow(run, "id bigint, n bigint, set binary, shingles array<bigint>")


def _weighted(df: DataFrame, keys: list[str], name: str = "_w") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def merge(links: DataFrame) -> DataFrame:
    """id, label (smallest id of its class) of all ids in links (a, b). Every round sends each class to its smallest
    neighbour and follows these pointers to their ends, so the number of classes that still have links at least
    halves."""
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        to = cut_lineage(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to")))
        while True:  # the pointers lead to smaller ids; their length halves each time
            further = to.select(F.col("id").alias("to"), F.col("to").alias("_next"))
            fans = _weighted(to, ["to"])
            moved = cut_lineage(
                hot_join(to, further.join(fans, "to"), ["to"], "_w", ["id"]).select("id", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved"))
            )
            to = moved.select("id", "to")
            if moved.where("_moved").isEmpty():
                break
        if labels is None:
            labels = to.withColumnRenamed("to", "label")
        else:
            fans = _weighted(labels, ["label"])
            pointers = to.select(F.col("id").alias("label"), "to").join(fans, "label")
            kept = labels.join(to.select(F.col("id").alias("label")), "label", "left_anti")
            labels = hot_join(labels, pointers, ["label"], "_w", ["id"]).select("id", F.col("to").alias("label")).union(kept.select("id", "label"))
        labels = cut_lineage(labels)
        for side in ("a", "b"):
            ends = to.select(F.col("id").alias(side), "to").join(_weighted(edges, [side]), side)
            other = "b" if side == "a" else "a"
            edges = cut_lineage(hot_join(edges, ends, [side], "_w", [other]).select(F.col("to").alias(side), other))
        edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets (id, n, shingles) are similar enough."""
    for side in ("a", "b"):
        other = "b" if side == "a" else "a"
        named = sets.select(F.col("id").alias(side), F.col("shingles").alias(f"_{side}"))
        needed = cut_lineage(named.join(_weighted(pairs, [side]), side))
        pairs = hot_join(pairs, needed, [side], "_w", [other]).drop("_w")
        pairs = cut_lineage(pairs) if side == "a" else pairs
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return pairs.where(100 * common >= percent * union).select("a", "b")


def _enough(n: Column, rest: Column, other_n: Column, other_rest: Column, percent: int) -> Column:
    """Whether the smaller of what two sets can share at most is enough: 100 * common >= percent * (n + n' - common)."""
    return (100 + percent) * F.least(rest, other_rest, n, other_n) >= percent * (n + other_n)


def _tile_links(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between the rows of one tile that are asked (asks = 1) and the others, slice by slice."""
    asks = rows.column("asks").to_numpy() == 1
    q, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    slices_of = lambda places, size: [places[i : i + size] for i in range(0, len(places), size)]
    ids, n, rest, label = (rows.column(c).to_numpy() for c in ("id", "n", "rest", "label"))
    shingles = rows.column("shingles").combine_chunks()
    ends, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    found = []
    for some in slices_of(q, ASK_SLICE):
        for others in slices_of(y, MEMBER_SLICE):
            found += _slice_links(some, others, ids, n, rest, label, ends, flat, percent)
    return found


def _slice_links(
    q: np.ndarray, y: np.ndarray, ids: np.ndarray, n: np.ndarray, rest: np.ndarray, label: np.ndarray, ends: np.ndarray,
    flat: np.ndarray, percent: int,
) -> list[tuple[int, int]]:
    """Links between the rows q and the rows y, as a product of two 0/1 matrices of those that can have any."""

    def able(q: np.ndarray, y: np.ndarray) -> np.ndarray:
        least = np.minimum(rest[q][:, None], rest[y])
        return (label[q][:, None] != label[y]) & ((100 + percent) * least >= percent * (n[q][:, None] + n[y]))

    open_pairs = able(q, y)
    q, y = q[open_pairs.any(1)], y[open_pairs.any(0)]
    if not len(q):
        return []
    open_pairs = able(q, y)
    lists = [[flat[ends[i] : ends[i + 1]] for i in side] for side in (q, y)]
    held = [np.concatenate(x) for x in lists]
    owner = [np.repeat(np.arange(len(x)), [len(one) for one in x]) for x in lists]
    names = np.intersect1d(*held)  # shingles that both sides have
    column = [np.searchsorted(names, x) for x in held]
    used = [np.isin(x, names) for x in held]
    common = np.zeros((len(q), len(y)), np.float32)
    for low in range(0, len(names), 4096):
        sides = []
        for size, own, place, both in zip((len(q), len(y)), owner, column, used, strict=True):
            mine = both & (place >= low) & (place < low + 4096)
            matrix = np.zeros((size, 4096), np.float32)
            matrix[own[mine], place[mine] - low] = 1
            sides.append(matrix)
        common += sides[0] @ sides[1].T
    links = open_pairs & ((100 + percent) * common >= percent * (n[q][:, None] + n[y]))
    return [(int(ids[q[i]]), int(ids[y[j]])) for i, j in zip(*np.nonzero(links), strict=True)]


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, salt_by: Sequence[str]) -> DataFrame:
    """Inner join by one column to a written table, whose weight says how often a key occurs on the left. Keys with more
    than 1/HOT of the rows, fewer than HOT therefore, are named in the plan: their rows are dealt out over 4, 16, 64, ...
    salts, as many as they have HOT-ths of the rows, and the right rows are copied for each."""
    (key,) = on
    total = right.agg(F.sum(weight)).first()[0] or 0
    cuts: dict[int, list] = {}
    for r in right.where(F.col(weight) * HOT > total).select(key, weight).distinct().collect():
        n = 4
        while n * total < r[weight] * HOT:
            n *= 4
        cuts.setdefault(n, []).append(r[key])
    if not cuts:
        return left.join(right, key)
    salt, copies = F.lit(0).cast("bigint"), F.lit(1)
    for n, keys in cuts.items():
        salt = F.when(F.col(key).isin(keys), F.pmod(F.xxhash64(*salt_by), F.lit(n))).otherwise(salt)
        copies = F.when(F.col(key).isin(keys), F.lit(n)).otherwise(copies)
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), copies.cast("bigint") - 1))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", salts), [key, "_salt"]).drop("_salt")


def undecided_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of a bucket that are in different classes, from members (bucket, id, n, rest, label).

    Nodes outside their bucket's largest class are asked against all of the bucket, in tiles of bounded size: a bucket's
    askers are cut into blocks of about ASK_SHINGLES shingles and ASK_NODES nodes, its members into blocks of
    MEMBER_SHINGLES and MEMBER_NODES, and a task compares slices of two blocks as matrices. Only links leave it. A node
    that cannot reach the limit even with a partner as small as the bucket's smallest is not asked or matched."""
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("_m"), F.sum("n").alias("_s"), F.min("n").alias("_n"))
    top = F.max(F.struct("_m", "label", "_s")).alias("_top")
    buckets = by_label.groupBy("bucket").agg(top, F.sum("_m").alias("_w"), F.sum("_s").alias("_all"), F.count("*").alias("_labels"), F.min("_n").alias("_least"))
    blocks = lambda total, size, nodes, most: F.greatest(F.ceil(total / size), F.ceil(nodes / most)).cast("int")
    buckets = buckets.where("_labels > 1").select(
        "bucket", "_w", "_least", F.col("_top.label").alias("_largest"),
        blocks(F.col("_all") - F.col("_top._s"), ASK_SHINGLES, F.col("_w") - F.col("_top._m"), ASK_NODES).alias("_asked"),
        blocks(F.col("_all"), MEMBER_SHINGLES, F.col("_w"), MEMBER_NODES).alias("_held"),
    )
    mixed = salted_join(members, cut_lineage(buckets), ["bucket"], "_w", ["id"])
    mixed = cut_lineage(mixed.where((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("_least"))))

    def side(rows: DataFrame, asks: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        tile = F.xxhash64("bucket", "_ask", "_hold").alias("tile")
        placed = rows.withColumn("_ask" if asks else "_hold", block).select("*", copies.alias("_hold" if asks else "_ask"))
        return placed.select(tile, F.lit(asks).alias("asks"), "id", "n", "rest", "label")

    rows = cut_lineage(side(mixed.where("label <> _largest"), 1, "_asked", "_held").union(side(mixed, 0, "_held", "_asked")))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count("*").alias("nodes")).first()
    parts = max(size.shingles // (4 * MEMBER_SHINGLES), size.nodes // (4 * MEMBER_NODES)) + 1
    whole = cut_lineage(sets.join(_weighted(rows, ["id"]), "id").select("id", "shingles", "_w"))
    filled = salted_join(rows, whole, ["id"], "_w", ["tile"]).drop("_w")
    dealt = filled.withColumn("_part", F.pmod(F.xxhash64("tile"), F.lit(parts)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("tile").combine_chunks()
        tiles = group.column("tile").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(tiles)) + 1, [len(tiles)]])
        found = {pair for a, b in zip(cuts[:-1], cuts[1:], strict=True) for pair in _tile_links(group.slice(a, b - a).combine_chunks(), percent)}
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(1, initial=np.iinfo(np.int64).max), "b": pairs.max(1, initial=-1)})

    return dealt.groupBy("_part").applyInArrow(run, "a bigint, b bigint").distinct()


def classes(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, _row, n, set, label (id of the class, null for an empty set) of rows (doc_id, _row, _text); nodes' ids are internal."""
    signed = cut_lineage(signatures(rows))
    some = signed.where("n > 0")
    nodes = some.groupBy("set").agg(F.min(F.struct("_row", "n", "bands")).alias("_node"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("id"), "set", "copies", "_node.*"))
    named = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = cut_lineage(_weighted(named, ["bucket"]).where("_w > 1"))
    members = cut_lineage(salted_join(named, shared, ["bucket"], "_w", ["id"]).drop("_w"))
    # whole sets of the nodes that share a bucket, from one document of each
    wanted = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "_row", F.col("set").alias("_set"))
    texts = rows.select("_row", "_text").join(wanted, "_row")
    sets = whole_sets(texts.select("id", "_text")).join(wanted.select("id", F.col("_set").alias("set")), ["id", "set"], "left_semi")
    sets = cut_lineage(sets.select("id", "n", "shingles").dropDuplicates(["id"]))
    # rest: how many shingles a node can share at most
    alone = sets.select("id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("_w"), F.min("id").alias("id"))
    alone = alone.where("_w = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sized = sets.select("id", "n").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("rest"))
    able = cut_lineage(sized.where(100 * F.col("rest") >= percent * F.col("n")))
    members = cut_lineage(members.join(able, "id"))
    # hubs
    hubs = members.groupBy("bucket").agg(
        F.min(F.struct((1 - F.col("rest") / F.col("n")).alias("part"), "id", "n", "rest")).alias("_hub"), F.count("*").alias("_w")
    )
    hubs = cut_lineage(hubs.where("_w > 1").select("bucket", "_w", *(F.col(f"_hub.{c}").alias(f"_{c}") for c in ("id", "n", "rest"))))
    near = salted_join(members, hubs, ["bucket"], "_w", ["id"]).where(F.col("id") != F.col("_id"))
    near = near.where(_enough(F.col("n"), F.col("rest"), F.col("_n"), F.col("_rest"), percent))
    pairs = cut_lineage(near.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct())
    links = cut_lineage(verified(pairs, sets, percent))
    # what the hubs haven't decided
    labels = merge(links)
    more = cut_lineage(undecided_links(_labelled(members, labels), sets, percent))
    if not more.isEmpty():
        labels = merge(links.union(more))
    node_labels = cut_lineage(_labelled(nodes.select("id", "set", "copies"), labels).select("set", "label", "copies"))
    empty = signed.where("n = 0").select("doc_id", "_row", "n", "set", F.lit(None).cast("bigint").alias("label"))
    labelled = salted_join(some.select("doc_id", "_row", "n", "set"), node_labels, ["set"], "copies", ["doc_id", "_row"])
    return labelled.select("doc_id", "_row", "n", "set", "label").union(empty)


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df (id, ...) with the label of each id, its own if it has no links."""
    return df.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def document_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _row (hash of id and text), _text."""
    body = F.coalesce(df[text], F.lit(""))
    return df.select("doc_id", F.xxhash64(df["doc_id"], body).alias("_row"), body.alias("_text"))


def components(df: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of df."""
    found = cut_lineage(classes(document_rows(df, text), percent))
    smallest = found.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_w"))
    linked = salted_join(found.where("label IS NOT NULL"), cut_lineage(smallest), ["label"], "_w", ["doc_id", "set"])
    single = found.where("label IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").union(single).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(df: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of df with one of each class: the one with the smallest id, null last, and of repeated rows the smallest by
    their other columns. Rows with an empty set stay."""
    found = cut_lineage(classes(document_rows(df, text), percent))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")).alias("_first")
    chosen = found.where("label IS NOT NULL").groupBy("label").agg(first).select("_first._row")
    chosen = cut_lineage(chosen.union(found.where("label IS NULL").select("_row")).distinct())
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(F.xxhash64(df["doc_id"], body).alias("_row"), body.rlike(WORD).alias("_words"), F.struct("*").alias("_doc"))
    rows = rows.join(chosen, "_row", "left_semi")
    once = rows.where("_words").groupBy("_row").agg(F.min("_doc").alias("_doc")).select("_doc.*")
    return once.union(rows.where("NOT _words").select("_doc.*"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and verdict of every document."""
    return components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) u(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.other = links.x)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id
"""
