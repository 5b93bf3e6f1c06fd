"""Tagged text: the hand-off to a tagger and the parse of what comes back. Both narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import words

_FIELD = P.FIELD
TAGGED_WORD = rf"^(?:.*~)?{_FIELD}~({_FIELD})~({_FIELD})~({_FIELD})$"
_IS_ROOT = rf"~0~{_FIELD}(?: |$)"


def _sentences(text: Column) -> Column:
    """Runs of tagged words, blank-separated; any other word ends a run."""
    marked = F.transform(words(text), lambda w: F.when(w.rlike(TAGGED_WORD), w).otherwise("\n"))
    runs = F.transform(F.split(F.array_join(marked, " "), "\n"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: r != "")


def _trees(text: Column) -> Column:
    """As sentences, but a run without a root stays open and takes the next one in."""
    closed = F.transform(
        _sentences(text), lambda r: F.concat(r, F.when(r.rlike(_IS_ROOT), "\n").otherwise(" "))
    )
    return F.filter(F.transform(F.split(F.array_join(closed, ""), "\n"), lambda r: F.trim(r)), lambda r: r != "")


def parse_tagged(
    messages: DataFrame, text: str = "text", keep: Sequence[str] = ("msg_id",), unit: str = "sentence"
) -> DataFrame:
    """tokens(msg_id, sent_no, tok_no, word, pos, head, rel) from words of the form word~pos~head~rel. The word may
    hold "~"; its last piece and the three fields must not be empty. tok_no starts at 1 in every unit.

    unit="sentence": every other word ends the sentence (tag features). unit="tree": it does so only once the
    sentence has a root, head 0 (tree features)."""
    runs = _trees(F.col(text)) if unit == "tree" else _sentences(F.col(text))
    sents = messages.select(*keep, F.posexplode(runs).alias("sent_no", "_run"))
    toks = sents.select(*keep, "sent_no", F.posexplode(F.split("_run", " ")).alias("_i", "_t"))
    # every token is a tagged word, so its fields are its last pieces
    pieces = F.split("_t", "~")
    field = [F.element_at(pieces, i) for i in (-3, -2, -1)]
    tail = F.length(F.substring_index("_t", "~", -3)) + 1
    return toks.select(
        *keep,
        "sent_no",
        (F.col("_i") + 1).alias("tok_no"),
        F.substring(F.col("_t"), F.lit(1), F.length("_t") - tail).alias("word"),
        field[0].alias("pos"),
        field[1].try_cast("int").alias("head"),
        field[2].alias("rel"),
    )


def plain_from_tagged(text: Column) -> Column:
    """The message that the tags were put on: words without their fields, other words as they are."""
    def bare(w: Column) -> Column:
        return F.when(w.rlike(TAGGED_WORD), F.regexp_replace(w, rf"~{_FIELD}~{_FIELD}~{_FIELD}$", "")).otherwise(w)

    return F.array_join(F.transform(words(text), bare), " ")


def tag_sentences(messages: DataFrame, text: str = "text", keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """(msg_id, sent_no, tags): the tags of a sentence, blank-separated."""
    sents = messages.select(*keep, F.posexplode(_sentences(F.col(text))).alias("sent_no", "_run"))
    tag = rf"[^ ]*~({_FIELD})~{_FIELD}~{_FIELD}(?= |$)"
    return sents.select(*keep, "sent_no", F.regexp_replace("_run", tag, "$1").alias("tags"))


def cut_sentences(messages: DataFrame, text: str = "text", keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Tagger input: one row per sentence between newline and subject markers; ends_with is the marker behind it."""
    marker = f"(?:{P.NEWLINE}|{P.SUBJECT}){P.END}"
    # an empty last marker pairs with the last sentence
    ends = F.concat(F.regexp_extract_all(F.col(text), F.lit(f"({marker})"), 1), F.array(F.lit("")))
    pairs = F.arrays_zip(F.split(F.col(text), marker).alias("sentence"), ends.alias("ends_with"))
    return messages.select(*keep, F.posexplode(pairs).alias("sent_no", "_p")).select(
        *keep, "sent_no", F.col("_p.sentence").alias("sentence"), F.col("_p.ends_with").alias("ends_with")
    )


def join_sentences(sentences: DataFrame, text: str = "sentence", keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Tagger output back to one row per message, in order and with the markers."""
    part = F.struct("sent_no", F.concat(F.col(text), F.col("ends_with")).alias("s"))
    joined = sentences.groupBy(*keep).agg(
        F.count("*").alias("n_sentences"), F.array_sort(F.collect_list(part)).alias("_parts")
    )
    return joined.select(*keep, "n_sentences", F.array_join(F.col("_parts.s"), "").alias("text"))
