"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Test items and documents are sets of 5-word shingles in ASCII lower case. Items are parted by the size of their set into
classes [2^c, 2^(c+1)). An item's sketch is its k smallest shingle hashes (bottom-k MinHash), where k is one more than
the number of shingles that an item of its class may miss. A document that holds enough of an item therefore holds at
least one hash of its sketch, however long the document is: the search loses nothing. A document is probed with its
whole set, only by items that are small enough for it, and every candidate is verified by the exact shingles.

Sketches are broadcast while they have at most max_broadcast rows; beyond that, documents' hashes and sketches meet in a
shuffle join, and candidates fetch their texts by key.

Defined results: null, empty or blank texts and items have no shingles and match nothing. A text with one to four words
is one shingle, so a short item is found in documents that are just this item. Repeated rows give one pair. Equal items
under several ids are several items; an item without an id is not looked for. Columns not asked for are left out, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import let
from siftwell.llm.common import ascii_lower, table, word_array
from siftwell.operators.skew import hot_join
from siftwell.session import cut_lineage

SHINGLE = 5
MIN_PERCENT = 75  # of an item's shingles that a document must hold
MAX_BROADCAST = 500_000  # sketch rows that are broadcast


def _windows(words: Column, one: callable) -> Column:
    """one(words, i) for each window of SHINGLE words, or the whole sequence as one; no windows without words."""

    def build(w: Column) -> Column:
        whole = F.transform(F.array(F.lit(0)), lambda _: one([F.array_join(w, " ")]))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: one([F.get(w, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(w) >= SHINGLE, F.array_distinct(each)).when(F.size(w) > 0, whole).otherwise(F.slice(whole, 1, 0))

    return let(words, build)


def shingle_hashes(text: Column) -> Column:
    return _windows(word_array(ascii_lower(text)), lambda w: F.xxhash64(*w))


def shingle_strings(text: Column) -> Column:
    return _windows(word_array(ascii_lower(text)), lambda w: F.concat_ws(" ", *w))


def item_sketches(items: DataFrame, text: str = "text", min_percent: int = MIN_PERCENT) -> DataFrame:
    """item_id, _hash, _need: the sketch's hashes, and how many shingles a document must have to hold the item."""
    sized = items.select("item_id", shingle_hashes(items[text]).alias("_all")).where(F.size("_all") > 0)
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.size("_all").cast("double"))) + 1) - 1  # largest set of the class
    k = (F.floor(upper * (100 - min_percent) / 100) + 1).cast("int")
    need = F.ceil(F.size("_all") * min_percent / 100).cast("int")
    return sized.select("item_id", need.alias("_need"), F.explode(F.slice(F.sort_array("_all"), F.lit(1), k)).alias("_hash"))


def candidate_pairs(docs: DataFrame, sketches: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, _key, item_id, _text, n: each document that holds a hash of an item's sketch, once."""
    probes = docs.select("doc_id", "_key", "_text", shingle_hashes(F.col("_text")).alias("_all"))
    exploded = probes.select("doc_id", "_key", "_text", F.size("_all").alias("_size"), F.explode("_all").alias("_hash"))
    fits = F.col("_size") >= F.col("_need")
    if sketches.count() <= max_broadcast:
        found = exploded.join(F.broadcast(sketches), "_hash").where(fits)
        return found.groupBy("doc_id", "_key", "item_id").agg(F.first("_text").alias("_text"))
    shared = sketches.groupBy("_hash").agg(F.count("*").alias("_items"))
    keys = exploded.groupBy("_hash").agg(F.count("*").alias("_n")).join(shared, "_hash").select("_hash", "_n")
    weighted = cut_lineage(sketches.join(keys, "_hash"))
    found = hot_join(exploded.drop("_text"), weighted, ["_hash"], "_n", ["_key"], many=True).where(fits)
    pairs = cut_lineage(found.select("doc_id", "_key", "item_id").distinct())
    texts = pairs.groupBy("_key").agg(F.count("*").alias("_n"))
    keyed = docs.select("_key", "_text").join(texts.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return hot_join(pairs, keyed.join(texts, "_key"), ["_key"], "_n", ["doc_id", "item_id"]).drop("_n")


def contained_items(
    docs: DataFrame, items: DataFrame, text: str = "text", min_percent: int = MIN_PERCENT, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """doc_id, _key (digest of the text), item_id, n_shingles (of the item), n_common: one row for each document and item
    that it holds."""
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select("doc_id", F.md5(body).alias("_key"), body.alias("_text"))
    pairs = cut_lineage(candidate_pairs(rows, cut_lineage(item_sketches(items, text, min_percent)), max_broadcast))
    whole = items.select("item_id", shingle_strings(items[text]).alias("_item"), F.md5(items[text]).alias("_item_key"))
    whole = whole.dropDuplicates(["item_id", "_item_key"])
    used = pairs.groupBy("item_id").agg(F.count("*").alias("_n"))
    both = hot_join(pairs, cut_lineage(whole.join(used, "item_id")), ["item_id"], "_n", ["doc_id", "_key"], many=True)
    common = F.size(F.array_intersect(shingle_strings(F.col("_text")), F.col("_item")))
    counted = both.select(
        "doc_id", "_key", "item_id", F.size("_item").cast("bigint").alias("n_shingles"), common.cast("bigint").alias("n_common")
    )
    return counted.where(100 * F.col("n_common") >= min_percent * F.col("n_shingles"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common of every benchmark item in every document."""
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_common")


ORACLE = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (
  SELECT DISTINCT side, id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS g
  FROM texts, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) u(i)),
items AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id),
common AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c
  FROM shingles d JOIN shingles i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' GROUP BY d.id, i.id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_common FROM common JOIN items USING (item_id) WHERE 100 * c >= 75 * n
"""
