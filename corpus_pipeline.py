"""The corpus pipeline: documents -> quality -> near-duplicates -> benchmark passages -> secrets -> token ids.

Each stage works on all rows that its predecessor kept, and is written as a table before the next one reads it.
Documents leave in the first three stages; secrets are masked in their text; the last stage encodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, near_dup, quality, secrets
from siftwell.llm.common import table
from siftwell.session import cut_lineage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps and does not find toxic; it is trained on the labelled ones among them. Rows are told apart by two
    hashes of id, language and text; null ids and texts are kept like others."""
    key = [docs["doc_id"], docs["lang"], docs["text"]]
    rows = docs.select("doc_id", "lang", "text", F.xxhash64(*key).alias("_row"), F.hash(*key).alias("_row2"), F.struct("*").alias("_doc"))
    labels = table(spark, sf_dir, "labels")
    scored = quality.score(rows, quality.trusted_ids(labels), keep=("doc_id", "_row", "_row2"), toxic=quality.toxic_ids(labels))
    rejected = cut_lineage(scored.where("toxic OR NOT kept").select("_row", "_row2").distinct())
    few = rejected.count() <= quality.MAX_BROADCAST  # then texts stay where they are; else both sides are dealt by hash
    return rows.join(F.broadcast(rejected) if few else rejected, ["_row", "_row2"], "left_anti").select("_doc.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; documents without words stay."""
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none."""
    found = decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))
    leaks = cut_lineage(found.select("_key").distinct())
    keyed = docs.select(F.md5(F.coalesce(docs["text"], F.lit(""))).alias("_key"), F.struct("*").alias("_doc"))
    return keyed.join(leaks, "_key", "left_anti").select("_doc.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted anew where the text has changed."""
    found = secrets.scan(docs.select("text", F.struct("*").alias("_doc")), keep=("_doc",))
    masked = found.select("_doc", "spans", secrets.redacted(F.col("_text"), F.col("spans")).alias("_masked"))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast("bigint")}
    columns = [F.col("_doc")[c] for c in docs.columns]
    changed = F.size("spans") > 0
    return masked.select(
        *(F.when(changed, new[c]).otherwise(old).alias(c) if c in new else old.alias(c) for c, old in zip(docs.columns, columns, strict=True))
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (whether the ids decode to the text)."""
    vocabulary = bpe.load_vocabulary(bpe.default_path())
    encoded = bpe.encode(docs, vocabulary, ("doc_id", "lang", "source", "text"))
    sized = encoded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "_same": F.sha2(F.coalesce("text", F.lit("")), 256)})
    # written in between, else the tasks of an executor hold twice as many Python workers
    back = bpe.decode(cut_lineage(sized.drop("text")), vocabulary, ("doc_id", "lang", "source", "n_tokens", "ids", "_same"))
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("_same")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None  # neither the language model nor BPE can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
