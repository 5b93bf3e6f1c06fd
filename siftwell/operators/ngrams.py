"""N-grams, vocabularies and n-gram presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import patterns as P
from siftwell.functions.text import holds_any, let, words
from siftwell.operators.skew import dense_index, first_n_per_group, hot_join, sortable
from siftwell.session import cut_lineage

KEY = 64  # words up to so many letters are compared by equality, longer ones are verified


def normalise_markers(text: Column) -> Column:
    """Words joined by one blank; links, emoji and phones lose their payload: LINK25ENDVAR -> LINK."""
    kinds, line = [P.LINK, P.EMOJI, P.PHONE], f" {P.NEWLINE}{P.END} "
    # from where a word starts, and only in lines that hold a kind; a marker between blanks parts them, so no word lies in two
    pattern = f"(?<!{P.CHAR}){P.CHAR}*({'|'.join(kinds)}){P.CHAR}*{P.END}{P.CHAR}*"
    short = F.transform(F.split(text, line), lambda s: F.when(holds_any(s, kinds), F.regexp_replace(s, pattern, "$1")).otherwise(s))
    return F.array_join(words(F.when(holds_any(text, kinds), F.array_join(short, line)).otherwise(text)), " ")


def word_ngrams(joined: Column, n: int) -> Column:
    """Array of the n-grams of a blank-joined text. (Look-around: Java only.)"""
    gram = " ".join(["[^ ]+"] * n)
    return F.regexp_extract_all(joined, F.lit(f"({gram})" if n == 1 else f"(?<![^ ])(?=({gram}))"), 1)


def letter_ngrams(text: Column, n: int) -> Column:
    """Array of all substrings of n letters, in time linear in the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(.)" if n == 1 else f"(?s){P.WHOLE_LETTER}(?=(.{{{n}}}))"), 1)


def explode_ngrams(
    df: DataFrame,
    text: str = "text",
    kinds: Sequence[str] = ("word", "letter"),
    sizes: Sequence[int] = (1, 2, 3),
    keep: Sequence[str] = ("msg_id",),
    distinct: bool = False,
) -> DataFrame:
    """(keep..., kind, n, term), one row per occurrence, or one per message with distinct. Narrow."""
    slots = [(k, n) for k in kinds for n in sizes]
    make = {"word": lambda n: word_ngrams(F.col("_joined"), n), "letter": lambda n: letter_ngrams(F.col(text), n)}
    grams = [make[k](n) for k, n in slots]
    if distinct:
        grams = [F.array_distinct(g) for g in grams]
    joined = df.select(*keep, text, normalise_markers(F.col(text)).alias("_joined"))
    by_slot = joined.select(*keep, F.posexplode(F.array(*grams)).alias("_slot", "_terms"))
    return by_slot.select(
        *keep,
        F.get(F.array(*[F.lit(k) for k, _ in slots]), F.col("_slot")).alias("kind"),
        F.get(F.array(*[F.lit(n) for _, n in slots]), F.col("_slot")).alias("n"),
        F.explode("_terms").alias("term"),
    )


def ngram_counts(grams: DataFrame) -> DataFrame:
    """How often every n-gram occurs. Counted on the map side first, so frequent n-grams do not weigh on one task."""
    return grams.groupBy("kind", "n", "term").agg(F.count("*").alias("cnt"))


def fit_vocabulary(grams: DataFrame, min_count: int = 1, top: int | None = None) -> DataFrame:
    """vocab(kind, term, n, idx) of the given (training) rows. n counts rows, idx is dense from 0. min_count and top
    cut the vocabulary; by default it is whole. Counts and result are written once, since joins use them repeatedly."""
    counts = cut_lineage(grams.groupBy("kind", "term").agg(F.count("*").alias("n")))
    if min_count > 1:
        counts = counts.where(F.col("n") >= min_count)
    if top is not None:
        counts = first_n_per_group(counts, ["kind"], F.concat(sortable(-F.col("n")), "term"), top)
    return cut_lineage(dense_index(counts, ["kind", "term"]))


def fold_vocabulary(grams: DataFrame) -> DataFrame:
    """vocab(kind, term, n, folds) of all folds at once, without an index: n counts rows, folds has bit i set if fold i
    has the term. fold is 0..61."""
    seen = F.expr("bit_or(shiftleft(1L, fold))")
    return cut_lineage(grams.groupBy("kind", "term").agg(F.count("*").alias("n"), seen.alias("folds")))


def known_to_others(folds: Column, fold: Column) -> Column:
    """Whether a term is in the vocabulary that a fold is asked with, which is that of the other folds' rows."""
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), fold)
    return folds.bitwiseAND(F.bitwise_not(own)) != 0


def match_terms(grams: DataFrame, vocab: DataFrame, id_cols: Sequence[str] = ("msg_id",)) -> DataFrame:
    """Presence by whole n-gram: grams must be distinct per message. id_cols, kind, term, the vocabulary's other columns
    (idx, folds), value."""
    hits = hot_join(grams.select(*id_cols, "kind", "term"), vocab, ["kind", "term"], "n", id_cols)
    return hits.drop("n").withColumn("value", F.lit(1.0))


def _cut_words(text: Column) -> Column:
    """Array of the runs of a text: arrays of its words that are one blank apart."""
    broken = F.regexp_replace(text, f"{P.SPACE}{{2,}}|{P.SPACE.replace('[ ', '[', 1)}", "\n")
    runs = F.transform(F.split(broken, "\n"), lambda r: F.filter(F.split(r, " "), lambda w: w != ""))
    return F.filter(runs, lambda r: F.size(r) > 0)


def _units(text: Column) -> Column:
    """Different words, pairs and triples of neighbouring words of a text. No letters are kept that are more than KEY away
    from the blank inside a pair or triple, and longer words stand as overlapping pieces beside their two ends."""
    first, last = (lambda w: F.right(w, F.lit(KEY))), (lambda w: F.left(w, F.lit(KEY)))

    def pieces(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(w), F.lit(KEY))
        return F.concat(F.transform(starts, lambda i: F.substring(w, i, F.lit(2 * KEY))), F.array(first(w), last(w)))

    def alone(run: Column) -> Column:
        return F.flatten(F.transform(run, lambda w: F.when(F.length(w) <= KEY, F.array(w)).otherwise(pieces(w))))

    def side_by_side(run: Column, n: int) -> Column:
        starts = F.when(F.size(run) >= n, F.sequence(F.lit(0), F.size(run) - n)).otherwise(F.array().cast("array<int>"))
        middle = [lambda i, j=j: F.get(run, i + j) for j in range(1, n - 1)]
        if middle:
            starts = F.filter(starts, lambda i: F.length(middle[0](i)) <= KEY)
        return F.transform(
            starts, lambda i: F.concat_ws(" ", first(F.get(run, i)), *(m(i) for m in middle), last(F.get(run, i + (n - 1))))
        )

    runs = _cut_words(text)
    return let(runs, lambda rs: F.array_distinct(
        F.flatten(F.transform(rs, lambda r: F.concat(alone(r), side_by_side(r, 2), side_by_side(r, 3))))
    ))


def _n_words(term: Column) -> Column:
    return F.length(term) - F.length(F.replace(term, F.lit(" "), F.lit(""))) + 1


def _shorter(entries: DataFrame) -> DataFrame:
    """The beginnings and ends of entries (term): one word less, marked as one or the other."""
    first, last = F.substring_index("term", " ", 1), F.substring_index("term", " ", -1)
    head = F.substring(F.col("term"), F.lit(1), F.length("term") - F.length(last) - 1)
    tail = F.substring(F.col("term"), F.length(first) + 2, F.length("term"))
    sides = F.array(F.struct(head.alias("term"), F.lit(True).alias("_head")), F.struct(tail.alias("term"), F.lit(False).alias("_head")))
    return entries.select(F.inline(sides)).groupBy("term").agg(F.max("_head").alias("_head"), F.max(~F.col("_head")).alias("_tail"))


def _substring_rows(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(_unit, _w, _row): the terms that every unit holds, from units (_unit, _w) and terms (term, _row), which have as many
    words as the units that they are looked for in.

    A term lies in a unit if its first word ends the unit's first word, its last word begins the unit's last and those
    between are equal; a term of one word lies anywhere. So terms of n words are looked up only where their first and
    their last n - 1 words were found one level below. Those beginnings and ends are entries of that level."""
    entries = {n: terms.where(_n_words(F.col("term")) == n).withColumns({"_head": F.lit(False), "_tail": F.lit(False)}) for n in (1, 2, 3)}
    for n in (2, 1):
        entries[n] = entries[n].unionByName(_shorter(entries[n + 1]), allowMissingColumns=True)
    size, found = F.length("_unit"), []
    for n in (1, 2, 3):
        asked = units.where(_n_words(F.col("_unit")) == n)
        if n == 1:
            upto = lambda i: F.sequence(F.lit(1), F.least(F.lit(KEY), size - i + 1))
            parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(upto(i), lambda k: F.substring(F.col("_unit"), i, k)))
            asked = asked.withColumn("term", F.explode(F.array_distinct(F.flatten(parts))))
        else:
            begins = found[-1].where("_head").select(F.col("_unit").alias("_left"), F.col("term").alias("_begin"))
            ends = found[-1].where("_tail").select(F.col("_unit").alias("_right"), F.col("term").alias("_end"))
            first, last = F.length(F.substring_index("_unit", " ", 1)), F.length(F.substring_index("_unit", " ", -1))
            left, right = F.substring(F.col("_unit"), F.lit(1), size - last - 1), F.substring(F.col("_unit"), first + 2, size)
            # the last word of the end goes behind the beginning
            new = F.substring(F.col("_end"), size - first - last, F.length("_end"))
            asked = asked.withColumns({"_left": left, "_right": right}).join(begins, "_left").join(ends, "_right")
            asked = asked.withColumn("term", F.concat_ws(" ", "_begin", new)).select("_unit", "_w", "term")
        begun, ended = (F.col("_head") & F.col("_unit").endswith(F.col("term"))), (F.col("_tail") & F.col("_unit").startswith(F.col("term")))
        hits = asked.join(entries[n], "term").withColumns({"_head": begun, "_tail": ended})
        found.append(cut_lineage(hits.where("_row IS NOT NULL OR _head OR _tail")))
    rows = [f.where("_row IS NOT NULL").select("_unit", "_w", "_row") for f in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def match_substrings(
    df: DataFrame, vocab: DataFrame, text: str = "text", id_cols: Sequence[str] = ("msg_id",)
) -> DataFrame:
    """Presence by substring of the message, for blank-joined terms of up to three words: exact, without comparing
    messages to terms pair by pair.

    The different words, pairs and triples of neighbouring words of all messages are looked up once, by equality of parts
    of them (_substring_rows), and messages get what their words, pairs and triples hold. Only terms with a word of more
    than KEY letters are looked up by their first KEY letters and verified."""
    ids = list(id_cols)
    cols = [*ids, *(c for c in vocab.columns if c != "n")]
    is_long = F.col("term").rlike(f"[^ ]{{{KEY + 1},}}")

    said = df.select(*ids, F.explode(_units(F.col(text))).alias("_unit"))
    units = cut_lineage(said.groupBy("_unit").agg(F.count("*").alias("_w")))
    row = F.struct(*(F.col(c) for c in vocab.columns if c != "n"))
    plain = vocab.where(~is_long & ~F.col("term").rlike("^ | $|  | .* .* ") & (F.col("term") != ""))
    rows = _substring_rows(units, plain.select("term", row.alias("_row")))
    short = hot_join(said, rows, ["_unit"], "_w", ids, many=True).select(*ids, "_row.*")

    # a text without as long a word holds none of the long terms
    span = rf"{P.WHOLE_LETTER}(?=({P.CHAR}{{1,{KEY}}}(?: {P.CHAR}{{1,{KEY}}}){{0,2}}))"
    worded = df.where(F.col(text).rlike(f"[^ ]{{{KEY + 1}}}"))
    spans = worded.select(*ids, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(span), 1))).alias("_s"))
    keyed = vocab.where(is_long).withColumn("_key", F.substring("term", 1, KEY))
    keyed = keyed.join(keyed.groupBy("_key").agg(F.sum("n").alias("_w")), "_key")
    wide = spans.where(F.length("_s") >= KEY).select(*ids, F.substring("_s", 1, KEY).alias("_key")).distinct()
    long = (
        hot_join(wide, keyed, ["_key"], "_w", ids, many=True)
        .join(worded.select(*ids, text), ids)
        .where(F.col(text).contains(F.col("term")))
    )
    return short.select(*cols).unionByName(long.select(*cols)).distinct().withColumn("value", F.lit(1.0))
