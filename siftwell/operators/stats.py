"""Statistics per class and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import mean_positive


def message_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds link_length (mean), n_links, n_emoji, n_breaks of a censored message."""
    t = F.col(text)
    lengths = F.transform(
        F.regexp_extract_all(t, F.lit(f"{P.LINK}([0-9]+){P.END}"), 1), lambda n: n.cast("double")
    )
    positive = F.filter(lengths, lambda x: x > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return df.withColumns(
        {
            "link_length": F.coalesce(F.try_divide(total, F.size(positive).cast("double")), F.lit(0.0)),
            "n_links": F.regexp_count(t, F.lit(f"{P.LINK}[0-9]+{P.END}")),
            "n_emoji": F.regexp_count(t, F.lit(f"{P.EMOJI}.{P.END}")),
            "n_breaks": F.regexp_count(t, F.lit(P.NEWLINE)),
        }
    )


def class_statistics(counted: DataFrame, columns: tuple[str, ...] = ("link_length", "n_links", "n_emoji", "n_breaks")):
    """One row per class: mean of the values above zero."""
    return counted.groupBy("label").agg(*[mean_positive(F.col(c)).alias(c) for c in columns])


def class_glyphs(df: DataFrame, text: str = "text") -> DataFrame:
    """(label, glyph, n) from emoji markers."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{P.EMOJI}(.){P.END}"), 1)
    return df.select("label", F.explode(found).alias("glyph")).groupBy("label", "glyph").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, term: str, n: str = "n", top: int | None = None) -> DataFrame:
    """By count downwards, ties by term; with top only so many rows."""
    out = counts.orderBy(F.desc(n), term)
    return out.limit(top) if top is not None else out


def mean_positive_by(df: DataFrame, value: Column, group: str, name: str = "mean_positive") -> DataFrame:
    return df.groupBy(group).agg(mean_positive(value).alias(name))
