"""Scalar text functions. All are Column -> Column, built in, without state: they work on batch and streaming rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions import patterns as P


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once. A filter that Catalyst moves below a chain of projections puts the chain into
    one expression, and without this every mention of the value would be another copy of all steps before it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def holds_any(text: Column, literals: Sequence[str]) -> Column:
    """Whether the text holds one of the literals; a byte search, which is much cheaper than their alternation."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in literals])


def words(text: Column) -> Column:
    """Blank-separated words as an array."""
    return F.regexp_extract_all(text, F.lit(f"({P.WORD})"), 1)


def has_script(text: Column, script: str = "hebrew") -> Column:
    return text.rlike(f"[{P.SCRIPTS[script]}]")


def script_only(text: Column, script: str = "hebrew") -> Column:
    """Letters of the script and single blanks; no blank in front."""
    kept = F.regexp_replace(text, f"[^{P.SCRIPTS[script]} ]+", "")
    return F.ltrim(F.regexp_replace(kept, " +", " "))


def signs(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{P.SIGNS}]+", "")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7f]*$")


def non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7f]+", "")


def mean_positive(x: Column) -> Column:
    """Aggregate: mean of the values above zero, 0 if there are none."""
    return F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0))


def pad_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "([.:?!,])", " $1 ")


def squeeze_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, " +", " "), r"\t+", "\t")


def squeeze_blank_lines(text: Column) -> Column:
    """Take the first blank line out of every run of blank lines."""
    return F.regexp_replace(text, r"(^|\n)\r?\n((?:\r?\n)*)", "$1$2")


def drop_direction_marks(text: Column) -> Column:
    return F.regexp_replace(text, P.DIRECTION_MARKS + "+", "")


def seeded_key(key: Column, seed: int = 1) -> Column:
    """32 hex digits that order rows at random, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_number(text: Column) -> Column:
    """First 8 hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def fold_of(key: Column, k: int, seed: int = 1) -> Column:
    """Fold 0..k-1 of a row, from its key alone."""
    return (hash_number(F.concat(F.lit(f"{seed}|"), key.cast("string"))) % k).cast("int")
