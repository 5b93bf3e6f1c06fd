"""Exact duplicates, unions and conflicts. Copies are merged on the map side, so a text with very many copies is one
row per task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import lookup


def dedup(df: DataFrame, keys: Sequence[str], id_col: str = "msg_id") -> DataFrame:
    """One row per distinct key, with the smallest id and the number of copies."""
    return df.groupBy(*keys).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))


def dedup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count("*").alias("n_after"))
    )


def union_datasets(one: DataFrame, two: DataFrame, name: str = "both") -> DataFrame:
    """Both datasets under a new name; within a class a text is kept once."""
    cols = ["label", "text", "msg_id"]
    both = one.select(*cols).unionByName(two.select(*cols))
    return dedup(both, ["label", "text"]).withColumn("dataset", F.lit(name))


def distinct_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of different texts over all classes."""
    return df.agg(F.count_distinct(text).alias("n_distinct"))


def class_conflicts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Texts that occur in more than one class."""
    return (
        df.groupBy(text)
        .agg(
            F.count_if(F.col(label) == 0).alias("n_non_spam"),
            F.count_if(F.col(label) == 1).alias("n_spam"),
        )
        .where((F.col("n_non_spam") > 0) & (F.col("n_spam") > 0))
    )


def prune_datasets(df: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Only datasets that have rows in both classes."""
    full = (
        df.groupBy("dataset")
        .agg(F.count_if(F.col("label") == 0).alias("_ham"), F.count_if(F.col("label") == 1).alias("_spam"))
        .where((F.col("_ham") > 0) & (F.col("_spam") > 0))
        .select("dataset")
    )
    return lookup(df, full, ["dataset"])
