"""Masks: links, phone numbers, e-mail addresses, names, emoji, line breaks. Column -> Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import hash_number, let, non_ascii

# Invented names; pass your own lists.
DEFAULT_NAMES: tuple[str, ...] = ()
DEFAULT_POOL = ("אלף", "בית", "גימל")
AND_PREFIX = "ו"


def mask_breaks(text: Column) -> Column:
    """One trailing line break goes, every other one becomes a marker."""
    marker = f" {P.NEWLINE}{P.END}  "
    body = let(text, lambda t: F.when(t.endswith("\n"), F.regexp_replace(t, r"\r?\n\z", "")).otherwise(t))
    # without carriage returns breaks are literals
    return let(body, lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r?\n", marker)).otherwise(F.replace(t, F.lit("\n"), F.lit(marker))))


def with_subject(subject: Column, body: Column) -> Column:
    return F.concat(subject, F.lit(f" {P.SUBJECT}{P.END}  "), body)


def per_word(text: Column, f: Callable[[Column], Column]) -> Column:
    """Apply f to every word that is not a marker; gaps stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(f"({P.WORD}|{P.SPACE}+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.when(w.endswith(P.END), w).otherwise(f(w))), "")


def _link_word(word: Column) -> Column:
    from_scheme = F.regexp_extract(word, f"({P.LINK_FROM_SCHEME})", 1)
    link = F.when(from_scheme != "", from_scheme).otherwise(word)
    before = F.substring(word, F.lit(1), F.length(word) - F.length(link))
    masked = F.concat(before, F.lit(f" {P.LINK}"), F.length(link).cast("string"), F.lit(f"{P.END}  "))
    return F.when(word.rlike(P.LINK_HINT) & ~word.rlike(P.EMAIL_ADDRESS), masked).otherwise(word)


def mask_links(text: Column) -> Column:
    """A word with a scheme, a known host or a known ending becomes LINK<length>; the length counts from the scheme.
    An e-mail address of any domain is not a link."""
    return per_word(text, _link_word)


def phone_class(word: Column) -> Column:
    """1: 1x00 number; 2: four digits; 3: nine; 4: ten; 5: +972; @: tag; 0: none of these."""
    digits = F.regexp_count(word, F.lit("[0-9]"))
    return (
        F.when(word.rlike("^1.00"), "1")
        .when(digits == 4, "2")
        .when(digits == 9, "3")
        .when(digits == 10, "4")
        .when((digits == 12) & word.contains("@"), "@")
        .when((digits == 12) & word.contains("+"), "5")
        .otherwise("0")
    )


def _phone_word(word: Column) -> Column:
    before = F.regexp_extract(word, f"^(.*?){P.PHONE_EDGE}", 1)
    after = F.regexp_extract(word, f"^.*{P.PHONE_EDGE}(.*)$", 1)
    masked = F.concat(before, F.lit(f" {P.PHONE}"), phone_class(word), F.lit(f"{P.END}  "), after)
    digits = F.regexp_count(word, F.lit("[0-9]"))
    # every shape has four digits in a row, which most words fail at once
    return F.when(word.rlike("[0-9]{4}") & word.rlike(P.PHONE_SHAPE) & digits.isin(P.PHONE_DIGITS), masked).otherwise(word)


def mask_phones(text: Column) -> Column:
    return per_word(text, _phone_word)


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, P.EMAIL_ADDRESS, f" {P.EMAIL}{P.END}  ")


def mask_names(
    text: Column,
    names: Sequence[str],
    pool: Sequence[str] = DEFAULT_POOL,
    seed: int = 1,
    core: Callable[[Column], Column] = non_ascii,
    prefix: str = AND_PREFIX,
) -> Column:
    """A word whose core is a listed name, alone or behind the prefix, gets a name from the pool.
    The choice depends on the core and the seed, so a person keeps one new name. The list is a setting, not data."""
    listed = F.array(*[F.lit(n) for n in names])

    def one(word: Column) -> Column:
        c = core(word)
        bare = F.when(F.array_contains(listed, c), c).otherwise(F.substring(c, len(prefix) + 1, 1 << 30))
        return (
            F.when(F.array_contains(listed, c), F.replace(word, c, new_name(c, pool, seed)))
            .when(c.startswith(prefix) & F.array_contains(listed, bare), F.replace(word, bare, new_name(bare, pool, seed)))
            .otherwise(word)
        )

    return per_word(text, one) if names else text


def new_name(name: Column, pool: Sequence[str], seed: int) -> Column:
    """The name from the pool that stands for a name."""
    choices = F.array(*[F.lit(n) for n in pool])
    return F.get(choices, (hash_number(F.concat(F.lit(f"{seed}|"), name)) % len(pool)).cast("int"))


def mask_emoji(text: Column, glyphs: str = P.EMOJI_GLYPHS) -> Column:
    """Every glyph becomes EMOJI<glyph>; a glyph already inside a marker stays. (Look-around: Java only.)"""
    ahead = f"(?={P.BEYOND_LATIN})" if glyphs == P.EMOJI_GLYPHS else ""  # one test that most letters fail
    return F.regexp_replace(text, f"{ahead}(?=[{glyphs}])(?<!{P.EMOJI}(?=.{P.END}))(.)", f" {P.EMOJI}$1{P.END} ")
