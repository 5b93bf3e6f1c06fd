"""The word model of operator 5: what a document's worst stretch says about toxic text.

Symbols are words (lower case, without punctuation at their ends). Trusted text gives an interpolated Kneser-Ney model of
word pairs. Toxic text gives a Kneser-Ney model of words whose lower order is the trusted model, so a word that toxic text
does not have speaks neither for nor against its own spelling. A word's weight is log2(toxic / trusted) of its two
probabilities. A document's score is the largest sum of weights of a stretch of its words, less what it takes to name the
two ends of a stretch (2 log2 of the words), so a few bad words are not averaged away. Its word bits are the mean of
-log2(trusted) over its words. Labelled documents are scored without their own counts: neither limits nor figures come from what a model has seen of
the same document.

The counts are one table, key -> four numbers, whose keys are hashes of (language), (language, word) or (language, word,
word). Blocks of documents ask for the keys they need, one packed array for each shard of the model (quality.py), so no
table passes through one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import slices
from siftwell.session import cut_lineage

ENDS = ".,;:!?\"'()[]{}<>*$&%#|_~-↺"
NUMBERS = [f"x{i}" for i in range(4)]
_CACHE_WORDS = 500_000
_START = np.uint64(0x5354415254)  # stands before every text


def hash_on(seed: np.ndarray | int, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long; xxhash64(a, b) is hash_on(hash_on(42, a), b)."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    seed = np.uint64(seed) if isinstance(seed, int) else seed
    h = (seed + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return hash_on(hash_on(42, before), word)


class Words:
    """64-bit hashes of words; remembers them."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def pairs(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, ...]:
        """language, word before and word (hashes) of all words of all texts, and the place of the text they are in."""
        rows = [text.lower().split() for text in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        flat = [w for row in rows for w in row]
        for w in set(flat) - self.known.keys():
            self.known[w] = xxhash.xxh64_intdigest(w.strip(ENDS) or w)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        lang = np.fromiter((xxhash.xxh64_intdigest(x, seed=2) for x in langs), np.uint64, len(langs))
        owner = np.repeat(np.arange(len(rows)), sizes)
        word = hash_on(lang[owner], np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat)))
        before = np.empty_like(word)
        before[1:] = word[:-1]
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[first] = hash_on(lang[owner[first]], np.full(len(first), _START))
        return lang[owner], before, word, owner


def pair_counts(docs: DataFrame) -> DataFrame:
    """lang, b, c, n, m: pairs of words of documents (lang, _text, trusted, toxic), how often trusted and toxic text have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for piece in slices(batches, "_text", 8 << 20):
            lang, before, word, owner = words.pairs(piece.column("_text").to_pylist(), piece.column("lang").to_pylist())
            if len(word):
                _, first, place = np.unique(_pair(before, word), return_index=True, return_inverse=True)
                sums = [np.bincount(place, piece.column(c).to_numpy(zero_copy_only=False).astype(float)[owner]).astype(np.int64) for c in ("trusted", "toxic")]
                arrays = [*(x[first].view(np.int64) for x in (lang, before, word)), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["lang", "b", "c", "n", "m"])

    some = docs.where("trusted OR toxic").select("lang", "_text", "trusted", "toxic")
    counted = some.mapInArrow(count, "lang bigint, b bigint, c bigint, n bigint, m bigint")
    return counted.groupBy("lang", "b", "c").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _discount(n: str) -> Column:
    once, twice = F.count(F.when(F.col(n) == 1, 1)), F.count(F.when(F.col(n) == 2, 1))
    return F.coalesce(F.greatest(F.lit(0.1), once / F.nullif(once + 2 * twice, F.lit(0))), F.lit(0.5))


def model(counts: DataFrame) -> DataFrame:
    """key, x0, x1, x2, x3. A pair: its counts in trusted and toxic text. A word: how many trusted words follow it, how many
    kinds of them, and how many kinds of words it follows in trusted and in toxic text. A language (two keys): see below."""
    counts = cut_lineage(counts)
    seen = lambda n, what: F.count(F.when(F.col(n) > 0, 1)).alias(what)
    before = counts.groupBy("lang", F.col("b").alias("w")).agg(F.sum("n").alias("total"), seen("n", "kinds"))
    after = cut_lineage(counts.groupBy("lang", F.col("c").alias("w")).agg(seen("n", "k"), seen("m", "l")))
    words = before.join(after, ["lang", "w"], "full").na.fill(0)
    pairs = counts.groupBy("lang").agg(seen("n", "pairs"), _discount("n").alias("d2"), seen("m", "toxic_pairs"))
    kinds = after.groupBy("lang").agg(seen("k", "words"), _discount("k").alias("d1"), seen("l", "toxic_words"), _discount("l").alias("dt"))
    langs = cut_lineage(pairs.join(kinds, "lang"))
    as_row = lambda df, *c: df.select(*(F.expr(x).cast("double" if i else "bigint").alias(n) for i, (n, x) in enumerate(zip(["key", *NUMBERS], c, strict=True))))
    return (
        as_row(counts, "xxhash64(b, c)", "n", "m", "0", "0")
        .union(as_row(words, "w", "total", "kinds", "k", "l"))
        .union(as_row(langs, "lang", "pairs", "words", "d1", "d2"))
        .union(as_row(langs, "xxhash64(lang)", "toxic_pairs", "toxic_words", "dt", "0"))
    )


def asked(pairs: tuple[np.ndarray, ...]) -> np.ndarray:
    """The keys that these pairs of words need."""
    lang, before, word, _ = pairs
    lang = np.unique(lang)
    return np.unique(np.concatenate([_pair(before, word), before, word, lang, hash_on(42, lang)]))


def _per(owner: np.ndarray, of: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each place the sum of weights (1 each, if none) of its text's places that have the same `of`."""
    _, ids = np.unique(of, return_inverse=True)
    _, group = np.unique(owner * (len(ids) + 1) + ids, return_inverse=True)
    return np.bincount(group, weight)[group]


def word_scores(
    found: tuple[np.ndarray, ...], trusted: np.ndarray, toxic: np.ndarray, keys: np.ndarray, numbers: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Score of the worst stretch and word bits of each text (found: its pairs); nan where there are no words or a model that
    is needed is missing. keys are sorted and hold all that is asked; numbers has their four numbers, zeros if unknown."""
    lang, before, word, owner = found
    worst, bits = np.full(len(trusted), np.nan), np.full(len(trusted), np.nan)
    if not len(word):
        return worst, bits

    def answers(key: np.ndarray) -> np.ndarray:
        return numbers[np.searchsorted(keys, key)]

    pair = _pair(before, word)
    n, m = answers(pair)[:, :2].T
    total, kinds = answers(before)[:, :2].T
    k, l = answers(word)[:, 2:].T
    pairs, words, d1, d2 = answers(lang).T
    toxic_pairs, toxic_words, dt, _ = answers(hash_on(42, lang)).T
    # without the text's own counts
    own = _per(owner, pair)
    mine, bad = trusted[owner], toxic[owner]
    only = np.where(mine, own == n, bad & (own == m)) / own  # places of a pair that no other text has add up to one
    gone, all_gone = _per(owner, word, only), np.bincount(owner, only)[owner]
    kinds = kinds - np.where(mine, _per(owner, before, only), 0)
    total = total - np.where(mine, _per(owner, before), 0)
    n, k, pairs = (x - np.where(mine, y, 0) for x, y in ((n, own), (k, gone), (pairs, all_gone)))
    l, toxic_pairs = (x - np.where(bad, y, 0) for x, y in ((l, gone), (toxic_pairs, all_gone)))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (np.maximum(k - d1, 0) + d1 * words / (words + 1)) / pairs
        p = np.where(total > 0.5, (np.maximum(n - d2, 0) + d2 * kinds * p) / total, p)
        p = np.where(pairs > 0.5, p, np.nan)
        weight = np.where(toxic_pairs > 0.5, np.log2((np.maximum(l - dt, 0) + dt * toxic_words * p) / toxic_pairs / p), np.nan)
    sizes = np.bincount(owner, minlength=len(trusted))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.flatnonzero(sizes):
        here = slice(ends[i], ends[i + 1])
        run = np.concatenate([[0.0], np.cumsum(weight[here])])
        worst[i] = (run[1:] - np.minimum.accumulate(run[:-1])).max() - 2 * np.log2(sizes[i])
        bits[i] = -np.log2(p[here]).mean()
    return worst, bits
