"""Operator 5: quality by the perplexity of an interpolated modified Kneser-Ney model.

Characters are the symbols, in windows of three, each language by itself; a word that repeats the word before it is one
symbol of its own. All trusted text is counted: batches count their own windows, Spark adds the counts up. Counts,
continuation counts and context totals are tables sharded by their keys, joined into one table of bits per window.

Documents are dealt into blocks of some MB. A block asks each shard of the table for its distinct windows, in one packed
array, and the answers meet the block's documents again, which add up their bits. So neither model nor documents pass
through one place, whatever their size, and texts move once.

A document's perplexity is 2 ** (bits per symbol). Its score is the bits per symbol after PRIOR_SYMBOLS symbols with
the language's trusted mean were added, so that few symbols weigh little. The threshold of a language is a quantile of the
scores of its trusted documents, plus a margin; documents above it are rejected.

A second model, of words, finds toxic documents (word_model.py): one whose worst stretch is above the TOXIC_QUANTILE of
the language's trusted documents is toxic. kept is the verdict on quality alone; the pipeline drops either.

Defined results: a toxic label outweighs trust. null or empty text has no symbols, perplexity null, and is kept, as is any document of a language
without trusted text (threshold null). A null language is a language of its own. Repeated rows give equal rows. Ids of
trusted documents are looked up by equality, so a null id is never trusted. Without labels all documents are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm import word_model
from siftwell.llm.common import slices, table
from siftwell.operators.skew import hot_join
from siftwell.session import cut_lineage

BITS = 21  # of a code point
START = "\x02"  # stands twice before every text
AGAIN = "↺"  # stands for a word that repeats the word before it
BLOCK_BYTES = 4 << 20
PRIOR_SYMBOLS = 40
QUANTILE = 0.995
MARGIN_BITS = 0.5
TOXIC_QUANTILE = 0.99  # of the worst stretches of trusted documents
MAX_BROADCAST = 1_000_000  # trusted ids that are broadcast; beyond, they are joined by shuffle
STEPS = 1000  # scores are ranked in steps of 1/STEPS bit


def normal_text(text: Column) -> Column:
    again = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++(?=\1(?:[\x20\x09-\x0D]|$))"
    return F.regexp_replace(F.coalesce(text, F.lit("")), again, AGAIN)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows of all texts, one after the other, and how many each text has."""
    joined = "".join(START + START + text for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    pads = np.cumsum(sizes + 2)[:-1]  # where the next text's first pad stands
    keep = np.ones(len(codes), bool)
    keep[np.concatenate([pads - 2, pads - 1])] = False
    return codes[keep], sizes


def _those(langs: list[str], lang: str) -> np.ndarray:
    return np.fromiter((x == lang for x in langs), bool, len(langs))


def window_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: windows of all documents (lang, _text, trusted) and how often trusted ones have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text", 8 << 20):
            langs = piece.column("lang").to_pylist()
            trusted = piece.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            texts = np.array(piece.column("_text").to_pylist(), object)
            for lang in set(langs):
                mine = _those(langs, lang)
                codes, sizes = windows(texts[mine].tolist())
                weights = np.repeat(trusted[mine], sizes)
                if len(codes):
                    grams, places = np.unique(codes, return_inverse=True)
                    n = np.bincount(places, weights, len(grams)).astype(np.int64)
                    arrays = [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])

    counted = docs.select("lang", "_text", "trusted").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _types(n: str) -> list[Column]:
    """How many things were counted once, twice, three and four times, and more."""
    return [F.count(F.when(F.col(n) == i, 1)).alias(f"_{i}") for i in (1, 2, 3, 4)] + [F.count(F.when(F.col(n) > 2, 1)).alias("_more")]


def _discounts(prefix: str) -> list[Column]:
    n1, n2, n3, n4 = (F.col(f"_{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    steps = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    found = (F.when((n1 > 0) & (n > 0), i - (i + 1) * y * after / n) for i, n, after in steps)
    return [
        F.greatest(F.lit(0.1), F.least(F.coalesce(d, F.lit(i / 2)), F.lit(float(i)))).alias(f"{prefix}{i}")
        for i, d in enumerate(found, 1)
    ]


def _smoothed(n: Column, prefix: str, context: str, lower: Column) -> Column:
    """(n - its discount + what the context's discounts leave for lower) / total; lower alone in an unseen context."""
    d1, d2, d3 = (F.col(f"{prefix}{i}") for i in (1, 2, 3))
    count = F.coalesce(n, F.lit(0))
    discount = F.when(count >= 3, d3).when(count == 2, d2).when(count == 1, d1).otherwise(0.0)
    left = d1 * F.col(f"{context}_1") + d2 * F.col(f"{context}_2") + d3 * F.col(f"{context}_more")
    return F.when(F.col(f"{context}_total").isNull(), lower).otherwise((count - discount + left * lower) / F.col(f"{context}_total"))


def _contexts(rows: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    totals = rows.groupBy(*keys).agg(F.sum(n).alias(f"{name}_total"), *_types(n))
    return totals.select(*keys, f"{name}_total", *(F.col(f"_{i}").alias(f"{name}_{i}") for i in (1, 2, "more")))


def window_bits(counts: DataFrame) -> DataFrame:
    """lang, gram, bits: -log2 of the last character's probability after the two before it, for every window counted;
    windows of languages without trusted text are left out."""
    mask = (1 << BITS) - 1
    grams = cut_lineage(
        counts.select(
            "lang", "gram", "n", F.shiftright("gram", 2 * BITS).alias("a"),
            F.shiftright("gram", BITS).bitwiseAND(F.lit(mask)).alias("b"), F.col("gram").bitwiseAND(F.lit(mask)).alias("c"),
        )
    )
    three = grams.where("n > 0")
    two = cut_lineage(three.groupBy("lang", "b", "c").agg(F.count("*").alias("n2")))
    one = two.groupBy("lang", "c").agg(F.count("*").alias("n1"))
    discounts = (
        three.groupBy("lang").agg(*_types("n")).select("lang", *_discounts("x"))
        .join(two.groupBy("lang").agg(*_types("n2")).select("lang", *_discounts("y")), "lang")
        .join(one.groupBy("lang").agg(*_types("n1")).select("lang", *_discounts("z")), "lang")
        .join(_contexts(one, ["lang"], "n1", "u"), "lang")
        .join(one.groupBy("lang").agg(F.count("*").alias("letters")), "lang")
        .join(grams.groupBy("lang").agg(F.count("*").alias("_weight")), "lang")
    )
    joined = (
        hot_join(grams, cut_lineage(discounts), ["lang"], "_weight", ["gram"])
        .drop("_weight")
        .join(_contexts(three, ["lang", "a", "b"], "n", "t"), ["lang", "a", "b"], "left")
        .join(_contexts(two, ["lang", "b"], "n2", "s"), ["lang", "b"], "left")
        .join(two, ["lang", "b", "c"], "left")
        .join(one, ["lang", "c"], "left")
    )
    p1 = _smoothed(F.col("n1"), "z", "u", 1 / (F.col("letters") + 1))
    p2 = _smoothed(F.col("n2"), "y", "s", p1)
    p3 = _smoothed(F.col("n"), "x", "t", p2)
    return joined.select("lang", "gram", (-F.log2(p3)).alias("bits"))


def pack(numbers: np.ndarray) -> bytes:
    """8-byte numbers, their first bytes first, then their second ones and so on, compressed."""
    planes = np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


def _asked(texts: np.ndarray, langs: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, ...], dict[str, tuple[np.ndarray, ...]]]:
    """All keys that texts need, in order; their pairs of words; by language places of texts, keys of its different windows,
    which of these each window is, and windows a text."""
    by_lang = {}
    for lang in set(langs):
        mine = np.flatnonzero(_those(langs, lang))
        codes, counts = windows(texts[mine].tolist())
        grams, which = np.unique(codes, return_inverse=True)
        seed = np.full(1, xxhash.xxh64_intdigest(lang, seed=42), np.uint64)
        by_lang[lang] = mine, word_model.hash_on(seed, grams.view(np.uint64)), which, counts
    pairs = word_model.Words().pairs(texts.tolist(), langs)
    return np.unique(np.concatenate([word_model.asked(pairs), *(grams for _, grams, _, _ in by_lang.values())])), pairs, by_lang


def document_bits(docs: DataFrame, bits: DataFrame, words: DataFrame, blocks: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, _lang, _trusted, n_symbols, bits (sum; null where the language has no model), worst and word_bits (see
    word_model) of documents (keep columns, lang, _text, trusted, toxic).

    The model is cut into as many shards as there are blocks of documents, by ranges of its keys' hashes. A block sends each
    shard one packed array of the keys it needs from there, and gets back an array of numbers in the same order. So an array
    holds thousands of keys in a small corpus and few in a very large one, and never more rows move than there are keys."""
    dealt = docs.select(F.pmod(F.xxhash64(keep[0], "_text"), F.lit(blocks)).cast("int").alias("block"), *keep, "lang", "_text", "trusted", "toxic")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    width = len(word_model.NUMBERS)

    def ask(group: pa.Table) -> pa.Table:
        texts = np.array(group.column("_text").to_pylist(), object)
        keys, _, _ = _asked(texts, group.column("lang").to_pylist())
        shards, starts = np.unique(((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), return_index=True)
        parts = np.split(keys, starts[1:]) if len(keys) else []
        block = np.full(len(shards), group.column("block")[0].as_py(), np.int32)
        packed = [pack(np.diff(part, prepend=np.zeros(1, np.uint64))) for part in parts]
        sizes = pa.array([len(part) for part in parts], pa.int32())
        return pa.table({"shard": pa.array(shards.astype(np.int32)), "block": pa.array(block), "n": sizes, "packed": pa.array(packed, pa.binary())})

    def look_up(messages: pa.Table, known: pa.Table) -> pa.Table:
        keys = known.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        # one row more, of zeros, for keys that the model does not have
        numbers = np.vstack([np.column_stack([known.column(x).to_numpy()[order] for x in word_model.NUMBERS]), np.zeros(width)])
        keys = keys[order]
        answers = []
        for n, packed in zip(messages.column("n").to_pylist(), messages.column("packed").to_pylist(), strict=True):
            wanted = np.cumsum(unpack(packed, n, np.uint64), dtype=np.uint64)
            place = np.searchsorted(keys, wanted)
            place[place < len(keys)] = np.where(keys[place[place < len(keys)]] == wanted[place < len(keys)], place[place < len(keys)], len(keys))
            answers.append(pack(numbers[place].T.copy()))
        return messages.select(["block", "shard", "n"]).append_column("packed", pa.array(answers, pa.binary()))

    def add_up(group: pa.Table, answers: pa.Table) -> pa.Table:
        texts = np.array(group.column("_text").to_pylist(), object)
        langs = group.column("lang").to_pylist()
        keys, pairs, by_lang = _asked(texts, langs)
        answers = answers.sort_by("shard")
        sent = zip(answers.column("n").to_pylist(), answers.column("packed").to_pylist(), strict=True)
        numbers = np.vstack([np.empty((0, width)), *(unpack(packed, n * width, np.float64).reshape(width, n).T for n, packed in sent)])
        totals = np.full(len(langs), np.nan)
        for mine, grams, which, counts in by_lang.values():
            x = numbers[np.searchsorted(keys, grams)]
            sums = np.concatenate([[0.0], np.cumsum(np.where(x[:, 1] > 0, x[:, 0], np.nan)[which])])
            ends = np.concatenate([[0], np.cumsum(counts)])
            totals[mine] = sums[ends[1:]] - sums[ends[:-1]]
        trusted, toxic = (group.column(c).to_numpy() for c in ("trusted", "toxic"))
        worst, word_bits = word_model.word_scores(pairs, trusted, toxic, keys, numbers)
        found = {"n_symbols": pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), "bits": pa.array(totals, from_pandas=True)}
        found |= {"worst": pa.array(worst, from_pandas=True), "word_bits": pa.array(word_bits, from_pandas=True)}
        return pa.table({**{c: group.column(c) for c in keep}, "_lang": group.column("lang"), "_trusted": group.column("trusted"), **found})

    message = "n int, packed binary"
    asked = dealt.groupBy("block").applyInArrow(ask, f"shard int, block int, {message}")
    known = bits.select(F.xxhash64("lang", "gram").alias("key"), F.col("bits").alias("x0"), *(F.lit(float(x == "x1")).alias(x) for x in word_model.NUMBERS[1:]))
    known = known.union(words.select("key", *word_model.NUMBERS))
    shard = F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(blocks).cast("bigint"), 32).cast("int").alias("shard")
    answers = asked.groupBy("shard").cogroup(known.select(shard, "*").groupBy("shard")).applyInArrow(look_up, f"block int, shard int, {message}")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"{kinds}, _lang string, _trusted boolean, n_symbols bigint, bits double, worst double, word_bits double")


def _limits(scored: DataFrame, name: str, quantile: float, margin: float, limit: str) -> DataFrame:
    """lang, limit: the quantile of the scores of the language's trusted documents, plus the margin."""
    steps = scored.where(F.col("trusted") & F.col(name).isNotNull()).groupBy("lang", F.ceil(F.col(name) * STEPS).alias("step")).agg(F.count("*").alias("n"))
    running = steps.select(
        "lang", "step",
        F.sum("n").over(W.partitionBy("lang").orderBy("step")).alias("upto"), F.sum("n").over(W.partitionBy("lang")).alias("all"),
    )  # at most some ten thousand steps a language
    return running.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg((F.min("step") / STEPS + margin).alias(limit))


def score(
    docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", quantile: float = QUANTILE,
    margin: float = MARGIN_BITS, max_broadcast: int = MAX_BROADCAST, keep: tuple[str, ...] = ("doc_id",),
    toxic: DataFrame | None = None, toxic_quantile: float = TOXIC_QUANTILE,
) -> DataFrame:
    """keep columns (doc_id first), lang, n_symbols, perplexity, score, threshold, word_bits, worst, worst_limit, toxic, kept: one
    row for each row of docs. trusted has doc_id, as has toxic; without toxic documents none is found toxic."""
    # a language is written with a sign before it, which leaves the empty string for null
    named = F.coalesce(F.concat(F.lit("="), docs[lang]), F.lit(""))
    rows = docs.select(*keep, named.alias("lang"), normal_text(docs[text]).alias("_text"))
    toxic = trusted.limit(0) if toxic is None else toxic
    labels = trusted.select("doc_id", F.lit(1).alias("t"), F.lit(0).alias("x")).union(toxic.select("doc_id", F.lit(0), F.lit(1)))
    ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("t") > 0).alias("trusted"), (F.max("x") > 0).alias("toxic"))
    ids = cut_lineage(ids.withColumn("trusted", F.expr("trusted AND NOT toxic")))
    known = F.broadcast(ids) if ids.count() <= max_broadcast else ids
    flagged = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("trusted", "toxic")})
    bits = cut_lineage(window_bits(window_counts(flagged)))
    words = word_model.model(word_model.pair_counts(flagged))
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    found = document_bits(flagged, bits, words, size // BLOCK_BYTES + 1, keep)
    flagged = cut_lineage(found.withColumnsRenamed({"_lang": "lang", "_trusted": "trusted"}))
    means = flagged.where("trusted AND n_symbols > 0").groupBy("lang").agg((F.sum("bits") / F.sum("n_symbols")).alias("_mean"))
    sizes = flagged.groupBy("lang").agg(F.count("*").alias("_rows"))
    weighted = cut_lineage(sizes.join(means, "lang", "left"))
    shrunk = (F.col("bits") + PRIOR_SYMBOLS * F.col("_mean")) / (F.col("n_symbols") + PRIOR_SYMBOLS)
    scored = hot_join(flagged, weighted, ["lang"], "_rows", ["doc_id"]).withColumn("score", F.when(F.col("n_symbols") > 0, shrunk))
    scored = cut_lineage(scored.drop("_rows", "_mean"))
    limits = _limits(scored, "score", quantile, margin, "threshold").join(_limits(scored, "worst", toxic_quantile, 0.0, "worst_limit"), "lang", "full")
    judged = hot_join(scored, cut_lineage(sizes.join(limits, "lang", "left")), ["lang"], "_rows", ["doc_id"])
    return judged.select(
        *keep,
        F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 20)).alias("lang"),
        "n_symbols",
        F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_symbols"))).alias("perplexity"),
        "score",
        "threshold",
        "word_bits",
        "worst",
        "worst_limit",
        F.coalesce(F.col("worst") > F.col("worst_limit"), F.lit(False)).alias("toxic"),
        F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND toxic = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    return labels.where("toxic = 1").select("doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdicts of every document: kept (quality) and toxic."""
    labels = table(spark, sf_dir, "labels")
    return score(table(spark, sf_dir, "documents"), trusted_ids(labels), toxic=toxic_ids(labels))
