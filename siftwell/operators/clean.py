"""Cleaning of raw messages: split, filter, squeeze. Narrow projections, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import drop_direction_marks, has_script


def strip_header(line: Column) -> Column:
    """The line without "[time] sender: ", cut at the first ": "."""
    return F.regexp_replace(drop_direction_marks(line), P.CHAT_HEADER, "")


def holds_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases], F.lit(False))


def drop_system_lines(df: DataFrame, line: str = "line", phrases: Sequence[str] = P.SYSTEM_PHRASES) -> DataFrame:
    return df.where(~holds_any(drop_direction_marks(F.col(line)), phrases))


def split_on_blank_line(df: DataFrame, text: str = "body", part: str = "part_no") -> DataFrame:
    """One row per part. Exactly one blank line separates; two or more stay in the text. (Look-around: Java only.)"""
    parts = F.split(F.col(text), r"(?<!\n)\n\n(?!\n)")
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(parts).alias(part, text))


def split_on_separator_rows(df: DataFrame, text: str = "text", part: str = "part_no") -> DataFrame:
    """One row per part between separator rows, with the number of plus rows of the whole text in n_plus_rows."""
    row = rf"(?:^|(?<=\n)|\r?\n)[^\n]*(?:{P.DASH_ROW}|{P.any_of([P.PLUS_ROW])})[^\n]*(?:\r?\n|$)"
    plus = rf"(?m)^[^\n]*{P.any_of([P.PLUS_ROW])}[^\n]*$"
    others = [c for c in df.columns if c != text]
    return df.select(
        *others,
        F.regexp_count(F.col(text), F.lit(plus)).alias("n_plus_rows"),
        F.posexplode(F.split(F.col(text), row)).alias(part, text),
    )


def keep_script(df: DataFrame, text: str = "text", script: str = "hebrew") -> DataFrame:
    return df.where(has_script(F.col(text), script))


def is_rejected(text: Column, token: str = "ul") -> Column:
    """The tagger answers a message that it cannot take with one word."""
    return F.btrim(text, F.lit(P.SPACES)) == token


def drop_rejected(df: DataFrame, text: str = "text", token: str = "ul") -> DataFrame:
    return df.where(~is_rejected(F.col(text), token))


def rejected_counts(df: DataFrame, text: str = "text", token: str = "ul", dataset: str = "dataset") -> DataFrame:
    hit = is_rejected(F.col(text), token)
    return df.groupBy(dataset).agg(F.count_if(hit).alias("n_rejected"), F.count_if(~hit).alias("n_kept"))
