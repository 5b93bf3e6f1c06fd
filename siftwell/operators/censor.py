"""The censor chain as one narrow job, and what is read back from censored text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import masks as M
from siftwell.functions import patterns as P
from siftwell.functions.text import holds_any, let, non_ascii, words
from siftwell.operators.skew import lookup
from siftwell.session import cut_lineage


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(P.SPACES))


def mask_listed_names(
    df: DataFrame,
    names: DataFrame,
    pool: Sequence[str] = M.DEFAULT_POOL,
    seed: int = 1,
    core: Callable[[Column], Column] = non_ascii,
    prefix: str = M.AND_PREFIX,
    text: str = "text",
) -> DataFrame:
    """functions.masks.mask_names with the names in the first column of a table of any size. The different words of all
    texts are joined to the names once; a text gets back a map of those of its words that are names, and other texts are
    left as they are. Null and empty names are no names; null texts stay null."""
    name = names.select(F.col(names.columns[0]).alias("_name")).where("_name <> ''").distinct()
    said = df.select(F.md5(F.col(text)).alias("_key"), F.explode(F.array_distinct(words(F.col(text)))).alias("_word"))
    known = said.select("_word").distinct().where(~F.col("_word").endswith(P.END)).withColumn("_core", core(F.col("_word")))
    bare = F.when(F.col("_core").startswith(prefix), F.substring(F.col("_core"), F.lit(len(prefix) + 1), F.length("_core")))
    known = cut_lineage(known.withColumn("_bare", bare))
    whole = lookup(known, name.withColumnRenamed("_name", "_core"), ["_core"]).withColumn("_of", F.col("_core"))
    behind = lookup(known.join(whole.select("_word"), "_word", "left_anti"), name.withColumnRenamed("_name", "_bare"), ["_bare"]).withColumn("_of", F.col("_bare"))
    both = whole.select("_word", "_of").unionByName(behind.select("_word", "_of"))
    changed = both.select("_word", F.replace(F.col("_word"), F.col("_of"), M.new_name(F.col("_of"), pool, seed)).alias("_new"))
    maps = lookup(said, changed, ["_word"]).groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("_word", "_new"))).alias("_names"))
    rows = lookup(df.withColumn("_key", F.md5(F.col(text))), maps, ["_key"], "left")
    masked = M.per_word(F.col(text), lambda w: F.coalesce(F.element_at(F.col("_names"), w), w))
    return rows.withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(masked)).select(*df.columns)


def censor(
    df: DataFrame,
    text: str = "text",
    names: Sequence[str] | DataFrame = M.DEFAULT_NAMES,
    pool: Sequence[str] = M.DEFAULT_POOL,
    glyphs: str = P.EMOJI_GLYPHS,
    seed: int = 1,
) -> DataFrame:
    """Breaks, links, phones, names, e-mails, emoji, in this order. The word loops run only in messages that hold
    something to mask, those for links, phones and e-mails only in the lines that do. One narrow projection, in which
    every step is mentioned once by the next; if names are a table, there are two, with a join between them."""

    def guarded(value: Column, hint: Callable[[Column], Column], mask: Callable[[Column], Column]) -> Column:
        return let(value, lambda t: F.when(hint(t), mask(t)).otherwise(t))

    def by_line(value: Column, hint: Callable[[Column], Column], mask: Callable[[Column], Column]) -> Column:
        # a line ends with a marker between blanks, so no word lies in two lines
        line = f" {P.NEWLINE}{P.END}  "
        masked = lambda t: F.array_join(F.transform(F.split(t, line), lambda s: F.when(hint(s), mask(s)).otherwise(s)), line)
        return guarded(value, hint, masked)

    out = _strip(M.mask_breaks(F.col(text)))
    out = by_line(out, lambda t: holds_any(t, P.LINK_PARTS), M.mask_links)
    # every shape has four digits in a row
    out = by_line(out, lambda t: t.rlike("[0-9]{4}") & t.rlike(P.PHONE_SHAPE), M.mask_phones)
    if isinstance(names, DataFrame):
        df = mask_listed_names(df.withColumn(text, out), names, pool, seed, text=text)
        out = F.col(text)
    elif names:
        out = guarded(out, lambda t: holds_any(t, names), lambda t: M.mask_names(t, names, pool, seed))
    out = by_line(out, lambda t: t.contains("@"), M.mask_emails)
    any_glyph = P.BEYOND_LATIN if glyphs == P.EMOJI_GLYPHS else f"[{glyphs}]"
    out = guarded(out, lambda t: t.rlike(any_glyph), lambda t: M.mask_emoji(t, glyphs))
    return df.withColumn(text, _strip(out))


def extract_variables(df: DataFrame, text: str = "text", keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """One row per marker: kind, payload (empty if none) and pos, the index of its word in the message."""
    tokens = df.select(*keep, F.posexplode(words(F.col(text))).alias("pos", "_word"))
    tokens = tokens.where(F.col("_word").contains(P.END))
    return tokens.where(F.col("_word").rlike(P.MARKER)).select(
        *keep,
        F.regexp_extract("_word", P.MARKER, 1).alias("kind"),
        F.regexp_extract("_word", P.MARKER, 2).alias("payload"),
        "pos",
    )


def glyph_inventory(df: DataFrame, text: str = "text", glyphs: str = P.EMOJI_GLYPHS) -> DataFrame:
    """How often every glyph occurs in the corpus."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([{glyphs}])"), 1)
    return df.select(F.explode(found).alias("glyph")).groupBy("glyph").agg(F.count("*").alias("n"))
