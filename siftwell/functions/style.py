"""Style scalars of a message with markers. Two narrow projections of regular expressions over the whole text;
the only loop over words is for the place of links, and runs only in messages that have one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import has_script, let, words

PHONE_CLASSES = ["1", "2", "3", "4", "5", "@"]

STYLE_COLUMNS = [
    "n_words", "n_letters", "n_links", "link_length", "link_place",
    "phone_1", "phone_2", "phone_3", "phone_4", "phone_5", "phone_at",
    "longest_word", "n_signs", "sign_share", "n_punctuation", "n_emoji", "emoji_share",
    "script_share", "script_ratio", "n_sentences", "n_digits", "digit_share",
]

_START = f"(?<!{P.CHAR})"  # a word starts here (Java only)


def _starting(kind: str) -> str:
    """A literal that starts a word, looked for before what stands in front of it: most letters fail at its first one."""
    return f"{kind}(?<!{P.CHAR}{kind})"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, others: str) -> Column:
    """How many letters are not of the class others, which goes in runs: cheaper than counting letters one by one."""
    return F.length(F.regexp_replace(text, f"[{others}]+", ""))


def _marker(text: Column, kind: str, payload: str = "") -> Column:
    """Markers of a kind; the pattern is looked for only in texts that hold its kind."""
    return F.when(~text.contains(kind), 0).otherwise(_count(text, f"{_starting(kind)}{payload}{P.END}"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def without_markers(text: Column) -> Column:
    """The text without the words that hold a marker. Line breaks between blanks, the most frequent ones, go as literals,
    and only lines with other markers are searched for them, from where their words start."""
    line, word = f" {P.NEWLINE}{P.END} ", f"{_START}{P.CHAR}*{P.END}{P.CHAR}*"
    rest = F.transform(F.split(text, line), lambda s: F.when(s.contains(P.END), F.regexp_replace(s, word, " ")).otherwise(s))
    return F.array_join(rest, "   ")


def sentence_count(text: Column) -> Column:
    """1 + line breaks that directly follow a word; the subject marker and a break are not words."""
    breaks = f"(?:{P.NEWLINE}|{P.SUBJECT}){P.END}"
    found = _count(text, f"{_START}(?!{breaks}){P.WORD}{P.SPACE}+{P.NEWLINE}{P.END}")
    # where every break stands between blanks and there is no subject, pieces between breaks that hold a word are counted
    line = f" {P.NEWLINE}{P.END} "
    odd = F.replace(text, F.lit(line), F.lit("  ")).contains(f"{P.NEWLINE}{P.END}") | text.contains(P.SUBJECT)
    pieces = F.split(text, line)
    ended = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.rlike(P.CHAR))
    return 1 + F.when(odd, found).otherwise(F.array_size(ended))


def link_lengths(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"{_starting(P.LINK)}([0-9]+){P.END}"), 1)
    return F.transform(found, lambda n: n.cast("bigint"))


def _mean(values: Column) -> Column:
    return let(values, lambda v: _share(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x), F.size(v)))


def link_places(text: Column) -> Column:
    """Word index over word count, for every link."""
    def places(all_words: Column) -> Column:
        # the literal before the pattern, which most words then never meet
        is_link = lambda w: w.startswith(P.LINK) & w.rlike(f"^{P.LINK}[0-9]+{P.END}")
        at = F.transform(all_words, lambda w, i: F.when(is_link(w), i.cast("double") / F.size(all_words)))
        return F.filter(at, lambda p: p.isNotNull())

    return let(words(text), places)


def add_style(df: DataFrame, text: str = "text", script: str = "hebrew") -> DataFrame:
    """Every column of STYLE_COLUMNS. Share columns are 0 where there is nothing to divide by."""
    t = F.col(text)
    letters = P.SCRIPTS[script]
    counted = df.withColumns(
        {
            "_plain": without_markers(t),
            "n_links": _marker(t, P.LINK, "[0-9]+"),
            "n_emoji": _marker(t, P.EMOJI, "."),
            "_emails": _marker(t, P.EMAIL),
            "_phones": _marker(t, P.PHONE, "[0-9@]"),
            "n_sentences": sentence_count(t),
            **{
                f"phone_{'at' if c == '@' else c}": _marker(t, P.PHONE, c) for c in PHONE_CLASSES
            },
        }
    )
    plain = F.col("_plain")
    # what is no white space is in a word, so words are looked for once for their number, their letters and the longest
    measured = counted.withColumn("_lengths", F.transform(words(plain), lambda w: F.length(w))).withColumns(
        {
            "n_words": F.array_size("_lengths") + F.col("_emails") + F.col("n_links") + F.col("_phones"),
            "n_letters": F.aggregate("_lengths", F.lit(0), lambda a, n: a + n) + F.col("n_emoji"),
            "link_length": F.when(F.col("n_links") > 0, _mean(link_lengths(t))).otherwise(0.0),
            "link_place": F.when(F.col("n_links") > 0, _mean(link_places(t))).otherwise(0.0),
            "longest_word": F.coalesce(F.array_max("_lengths"), F.lit(0)),
            "n_signs": _count(plain, f"[{P.SIGNS}]"),
            "n_punctuation": _count(plain, f"[{P.PUNCTUATION}]"),
            "n_digits": _count(plain, r"[0-9\p{Nd}]"),
            "_script": _without(plain, P.BESIDE_LATIN) if script == "latin" else _count(plain, f"[{letters}]"),
            "_alpha": _without(plain, r"^A-Za-z\p{L}"),
            "_latin": _without(plain, P.BESIDE_LATIN),
        }
    )
    shared = measured.withColumns(
        {
            "sign_share": _share(F.col("n_signs"), F.col("n_letters")),
            "emoji_share": _share(F.col("n_emoji"), F.col("n_letters")),
            "digit_share": _share(F.col("n_digits"), F.col("n_letters")),
            "script_share": _share(F.col("_script"), F.col("_alpha")),
            "script_ratio": _share(F.col("_script"), F.col("_latin")),
        }
    )
    return shared.drop("_plain", "_lengths", "_emails", "_phones", "_script", "_alpha", "_latin")


def gate_by_script(df: DataFrame, columns: list[str], text: str = "text", script: str = "hebrew") -> DataFrame:
    """All columns become 0 in a message without a letter of the script."""
    ok = has_script(F.col(text), script)
    return df.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType)) for c in columns})
