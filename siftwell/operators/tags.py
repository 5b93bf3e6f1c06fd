"""Part-of-speech features, from tag strings (one per sentence) or from token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.operators.ngrams import word_ngrams

BLOCK = 10_000  # tokens of a sentence that one window sees


def tag_counts(tokens: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(msg_id, pos, n), long."""
    return tokens.groupBy(id_col, "pos").agg(F.count("*").alias("n"))


def tag_count_columns(tokens: DataFrame, tags: Sequence[str], id_col: str = "msg_id") -> DataFrame:
    """One column pos_<tag> per tag of the (training) tag list."""
    return tokens.groupBy(id_col).agg(*[F.count_if(F.col("pos") == t).alias(f"pos_{t}") for t in tags])


def tag_vocabulary(tokens: DataFrame) -> DataFrame:
    """Tags of the training rows, with counts."""
    return tokens.groupBy("pos").agg(F.count("*").alias("n"))


def tag_ngrams(
    sentences: DataFrame, tags: str = "tags", sizes: Sequence[int] = (1, 2, 3),
    keep: Sequence[str] = ("msg_id", "sent_no"),
) -> DataFrame:
    """(msg_id, sent_no, term) per occurrence, from blank-separated tag strings. Narrow."""
    grams = F.concat(*[word_ngrams(F.col(tags), n) for n in sizes])
    return sentences.select(*keep, F.explode(grams).alias("term"))


def tag_ngrams_of_tokens(
    tokens: DataFrame, n_max: int = 3, keep: Sequence[str] = ("msg_id", "sent_no"), pos: str = "pos"
) -> DataFrame:
    """The same from token rows, tok_no being dense. A sentence is cut into blocks of BLOCK tokens that also get the
    first tokens of the next block, so that no window grows with the sentence."""
    ahead = n_max - 1
    block = F.floor(F.col("tok_no") / BLOCK)
    own = F.when(F.col("tok_no") % BLOCK < ahead, F.array(block, block - 1)).otherwise(F.array(block))
    rows = tokens.select(*keep, "tok_no", pos, block.alias("_own"), F.explode(own).alias("_block"))
    w = W.partitionBy(*keep, "_block").orderBy("tok_no")
    steps = [F.col(pos), *[F.lead(pos, i).over(w) for i in range(1, n_max)]]
    with_next = rows.select(*keep, "_own", "_block", *[s.alias(f"_t{i}") for i, s in enumerate(steps)])
    grams = [
        F.when(F.col(f"_t{n}").isNotNull(), F.concat_ws(" ", *[F.col(f"_t{i}") for i in range(n + 1)]))
        for n in range(n_max)
    ]
    return (
        with_next.where(F.col("_own") == F.col("_block"))
        .select(*keep, F.explode(F.array(*grams)).alias("term"))
        .where(F.col("term").isNotNull())
    )


def ngram_counts(grams: DataFrame) -> DataFrame:
    """Vocabulary of tag n-grams: occurrences over all sentences."""
    return grams.groupBy("term").agg(F.count("*").alias("n"))


def ngram_sentences(grams: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """(msg_id, term, n): number of sentences of the message that hold the n-gram."""
    return grams.groupBy(id_col, "term").agg(F.count_distinct("sent_no").alias("n"))
