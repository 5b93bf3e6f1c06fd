"""Operator 2: removal of repeated word runs by recompression.

A window is WINDOW consecutive words of one text. A word is removed if some window over it occurs anywhere else.

Recompression turns texts into shorter and shorter sequences of symbols. In each round every maximal run of a symbol gets
one name, then symbols are parted into left and right ones by a bit of their name, and every pair left-right gets one
name. Names are hashes of what they stand for, so all tasks give the same run or pair the same name, without a
dictionary going round. Each symbol carries its support: the words that fix it, whatever stands around them. Equal
windows hold the same symbols with support inside, so they agree on an anchor, the symbol whose support has the
smallest hash. Then Spark counts:

1. An anchor's support that is found once in the whole corpus ends the matter for the windows that chose it. One
   aggregation finds these; what is left are long repeats and few others.
2. Texts with such windows are kept once each, with their number of copies. Their windows are verified by their own
   hashes below the anchor's; a window found once is no repeat.

Both aggregations return what occurs once, with its place, so nothing is joined by a hot key, and copies merge before they
move. Windows without an anchor (inside long runs and periods) stand for themselves, equal neighbours as one row.

Words and names are compared by 64-bit hashes, a window by its hash and its anchor's.

Defined results: null, empty and blank texts have no words; their kept text is empty. Texts shorter than WINDOW words
keep all. Copies of a text lose all their windows. Repeated rows are copies. Columns not asked for are left out,
whatever their names. Empty tables give no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import slices, table, word_array
from siftwell.operators.skew import hot_join
from siftwell.session import cut_lineage

WINDOW = 35
ROUNDS = 4  # supports then have about 20 words, which leaves some 15 places in a window to agree on
_CACHE_WORDS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.multiply.accumulate(steps)


class Corpus:
    """Words of some texts, one text after the other: names, owner of each word, where texts end (with a leading 0)."""

    def __init__(self, texts: list[bytes], known: dict[bytes, int]) -> None:
        self.rows = [text.split() for text in texts]
        flat = [w for row in self.rows for w in row]
        if len(known) > _CACHE_WORDS:
            known.clear()
        for word in set(flat) - known.keys():
            known[word] = xxhash.xxh64_intdigest(word)
        self.words = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
        self.ends = np.concatenate([[0], np.cumsum([len(row) for row in self.rows])]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.rows)), np.diff(self.ends))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.words) * _powers(_BASE, len(flat)), dtype=np.uint64)])
        self._back = _powers(_INVERSE, len(flat) + 1)

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first..last, the same wherever they stand."""
        return _mix((self._sums[last + 1] - self._sums[first]) * self._back[first] + (last - first).astype(np.uint64))


def recompress(corpus: Corpus, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, first and last word of the support of each symbol; a support that reaches over an end of its text lies one
    word outside. Both ends ascend within a text."""
    names, owner = corpus.words.copy(), corpus.owner
    first = np.arange(len(names))
    last = first.copy()
    for number in range(rounds if len(names) else 0):
        # runs: their neighbours must be known
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(names)) - 1
        length = (end - start + 1).astype(np.uint64)
        of = owner[start]
        opens, closes = np.ones(len(start), bool), np.ones(len(start), bool)
        opens[1:] = of[1:] != of[:-1]
        closes[:-1] = opens[1:]
        first, last = (
            np.where(opens, corpus.ends[of] - 1, first[np.maximum(start - 1, 0)]),
            np.where(closes, corpus.ends[of + 1], last[np.minimum(end + 1, len(names) - 1)]),
        )
        names = np.where(length > 1, _mix(names[start] * _GOLD + length + np.uint64(number << 32)), names[start])
        owner = of
        # pairs left-right: both sides of a pair are known, a single symbol must know the neighbour it could join
        right = (_mix(names ^ np.full(1, number + 1, np.uint64) * _GOLD) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(names), bool)
        joins[:-1] = ~closes[:-1] & ~right[:-1] & right[1:]
        joined = np.zeros(len(names), bool)
        joined[1:] = joins[:-1]
        after, before = np.minimum(np.arange(len(names)) + 1, len(names) - 1), np.maximum(np.arange(len(names)) - 1, 0)
        waits, follows = ~right & ~joins, right & ~joined
        known_first = np.where(follows, np.where(opens, corpus.ends[owner] - 1, first[before]), first)
        known_last = np.where(joins, last[after], np.where(waits, np.where(closes, corpus.ends[owner + 1], last[after]), last))
        paired = _mix(_mix(names + np.uint64(number + 1)) * _GOLD + names[after])
        names = np.where(joins, paired, names)[~joined]
        first, last, owner = known_first[~joined], known_last[~joined], owner[~joined]
    return owner, first, last


def _smallest(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the first smallest of values[low:high], for non-empty ranges."""
    best = [np.arange(len(values))]
    while (1 << len(best)) <= int((high - low).max(initial=1)):
        step = 1 << (len(best) - 1)
        a, b = best[-1][:-step], best[-1][step:]
        best.append(np.where(values[a] <= values[b], a, b))
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    found = np.empty(len(low), np.int64)
    for k in range(len(best)):
        at = np.flatnonzero(level == k)
        a, b = best[k][low[at]], best[k][high[at] - (1 << k)]
        found[at] = np.where(values[a] <= values[b], a, b)
    return found


def anchored(corpus: Corpus, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Ranges of windows that share an anchor, in order: owner, first and last window (its first word in the text), key,
    times (how often the key's words occur in the range: once, or as often as a window without anchor repeats)."""
    n = max(len(corpus.words) - window + 1, 0)
    start = np.flatnonzero(corpus.owner[:n] == corpus.owner[window - 1 :]) if n else np.empty(0, np.int64)
    of = corpus.owner[start]
    owner, first, last = recompress(corpus)
    inside = (first >= corpus.ends[owner]) & (last < corpus.ends[owner + 1])
    # texts are set apart by one word, so that supports that reach over an end stay between
    low = np.searchsorted(first + 2 * owner, start + 2 * of)
    high = np.searchsorted(last + 2 * owner, start + window - 1 + 2 * of, side="right")
    keys = np.zeros(len(owner), np.uint64)
    keys[inside] = corpus.hashes(first[inside], last[inside])
    has = high > low
    anchor = np.full(len(start), -1, np.int64)
    anchor[has] = _smallest(keys, low[has], high[has])
    key = np.empty(len(start), np.uint64)
    key[has] = keys[anchor[has]]
    alone = ~has
    key[alone] = _mix(corpus.hashes(start[alone], start[alone] + window - 1))
    new = np.ones(len(start), bool)
    new[1:] = (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1]) | (alone[1:] & (key[1:] != key[:-1]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(start)) - 1 if len(begin) else begin
    times = np.where(alone[begin], end - begin + 1, 1)
    base = corpus.ends[of[begin]]
    return of[begin], start[begin] - base, start[end] - base, key[begin], times


def _corpora(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Corpus]]:
    known: dict[bytes, int] = {}
    for piece in slices(batches, "_text", 1 << 20):
        yield piece, Corpus([text.encode() for text in piece.column("_text").to_pylist()], known)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(rows: DataFrame) -> DataFrame:
    """key, _t, _u, start, times of the ranges of all rows (_t, _u, _text), and ranges: how many the row's text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, corpus in _corpora(batches):
            owner, start, _, key, times = anchored(corpus)
            at = pa.array(owner)
            ranges = np.bincount(owner, minlength=piece.num_rows)[owner].astype(np.int32)
            arrays = [_signed(key), piece.column("_t").take(at), piece.column("_u").take(at), pa.array(start.astype(np.int32)), pa.array(times), pa.array(ranges)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "_t", "_u", "start", "times", "ranges"])

    return rows.select("_t", "_u", "_text").mapInArrow(run, "key bigint, _t bigint, _u int, start int, times bigint, ranges int")


def found_once(occurrences: DataFrame, keys: list[str], of_text: tuple[str, ...] = ()) -> DataFrame:
    """_t, _u, once (sorted array of starts) and of_text (columns alike in all rows of a text): what occurs once in all; only
    then are the minima those of one row."""
    total = occurrences.groupBy(*keys).agg(F.sum("times").alias("n"), *(F.min(c).alias(c) for c in ("_t", "_u", "start", *of_text)))
    starts = F.sort_array(F.collect_list("start")).alias("once")
    return total.where("n = 1").groupBy("_t", "_u").agg(starts, *(F.min(c).alias(c) for c in of_text))


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.empty(0, np.int32) for row in column]


def suspects(texts: DataFrame) -> DataFrame:
    """_t, _u, copies, _text, starts, ends, keys, times: the ranges of texts (_t, _u, copies, _text, once) whose anchor is
    found again; texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, corpus in _corpora(batches):
            owner, start, end, key, times = anchored(corpus)
            once = _lists(piece.column("once"))
            unique = np.concatenate([np.empty(0, np.int64), *(x.astype(np.int64) + (i << 40) for i, x in enumerate(once))])
            again = ~np.isin((owner << 40) + start, unique)
            owner, start, end, key, times = (x[again] for x in (owner, start, end, key, times))
            sizes = np.bincount(owner, minlength=piece.num_rows)
            rows = pa.array(np.flatnonzero(sizes))
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), _signed(key), pa.array(times))]
            kept = [piece.column(c).take(rows) for c in ("_t", "_u", "copies", "_text")]
            yield pa.RecordBatch.from_arrays([*kept, *lists], ["_t", "_u", "copies", "_text", "starts", "ends", "keys", "times"])

    lists = "starts array<int>, ends array<int>, keys array<bigint>, times array<bigint>"
    return texts.select("_t", "_u", "copies", "_text", "once").mapInArrow(run, f"_t bigint, _u int, copies bigint, _text string, {lists}")


def _flat(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """owner, start, end, key, times of the ranges of suspects."""
    lists = {c: _lists(piece.column(c)) for c in ("starts", "ends", "keys", "times")}
    owner = np.repeat(np.arange(piece.num_rows), [len(x) for x in lists["starts"]])
    return owner, *(np.concatenate([np.empty(0, np.int64), *lists[c]]) for c in ("starts", "ends", "keys", "times"))


def suspect_windows(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, window (hash), _t, _u, start, times: all windows of suspects; those without anchor once a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, corpus in _corpora(batches):
            owner, start, end, key, times = _flat(piece)
            copies = piece.column("copies").to_numpy()
            sizes = np.where(times > 1, 1, end - start + 1)  # equal windows are one row
            at = np.repeat(np.arange(len(owner)), sizes)
            place = start[at] + np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word = corpus.ends[owner[at]] + place
            rows = pa.array(owner[at])
            arrays = [
                pa.array(key[at]), _signed(corpus.hashes(word, word + window - 1)), piece.column("_t").take(rows),
                piece.column("_u").take(rows), pa.array(place.astype(np.int32)), pa.array(times[at] * copies[owner[at]]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "window", "_t", "_u", "start", "times"])

    return found.mapInArrow(run, "key bigint, window bigint, _t bigint, _u int, start int, times bigint")


def cut_texts(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """_t, _u, copies, n_removed, kept (the other words, joined by blanks) of suspects with once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, corpus in _corpora(batches):
            owner, start, end, _, _ = _flat(piece)
            steps = np.zeros(len(corpus.words) + len(corpus.rows) + window + 1, np.int64)  # +1 where windows begin
            base = corpus.ends[:-1][owner]
            np.add.at(steps, base + start, 1)
            np.add.at(steps, base + end + 1, -1)
            repeated = np.cumsum(steps)[: len(corpus.words)] > 0
            for i, once in enumerate(_lists(piece.column("once"))):
                repeated[corpus.ends[i] + once] = False
            at = np.flatnonzero(repeated)
            cover = np.zeros(len(corpus.words) + window + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[: len(corpus.words)] > 0
            kept, removed = [], []
            for i, row in enumerate(corpus.rows):
                mine = gone[corpus.ends[i] : corpus.ends[i + 1]]
                kept.append(b" ".join([row[j] for j in np.flatnonzero(~mine)]).decode())
                removed.append(int(mine.sum()))
            ids = [piece.column(c) for c in ("_t", "_u", "copies")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["_t", "_u", "copies", "n_removed", "kept"])

    return found.mapInArrow(run, "_t bigint, _u int, copies bigint, n_removed bigint, kept string")


def whole_and_cut(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Rows keep, _t, _u, n_words, _whole (all words, joined by blanks), and for each text that loses words one row _t, _u,
    copies, n_removed, kept."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(*keep, F.xxhash64(body).alias("_t"), F.hash(body).alias("_u"), body.alias("_text"))
    once = cut_lineage(found_once(anchors(rows), ["key"], ("ranges",)))
    texts = rows.groupBy("_t", "_u").agg(F.first("_text").alias("_text"), F.count("*").alias("copies"))
    # a text whose ranges are all found once has no window that is found again
    again = texts.join(once, ["_t", "_u"], "left").where("once IS NULL OR size(once) < ranges")
    found = cut_lineage(suspects(again))
    single = found_once(suspect_windows(found), ["key", "window"])
    cut = cut_lineage(cut_texts(found.join(single, ["_t", "_u"], "left")).where("n_removed > 0"))
    whole = rows.select(*keep, "_t", "_u", word_array(F.col("_text")).alias("_words")).select(
        *keep, "_t", "_u", F.size("_words").cast("bigint").alias("n_words"), F.array_join("_words", " ").alias("_whole")
    )
    return whole, cut


def remove_repeats(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words, n_removed, kept (the words that stay, joined by blanks): one row for each row of df."""
    whole, cut = whole_and_cut(df, text, keep)
    joined = hot_join(whole, cut, ["_t", "_u"], "copies", list(keep), "left")
    removed = F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed")
    return joined.select(*keep, "n_words", removed, F.coalesce("kept", "_whole").alias("kept"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; digests are taken before rows move."""
    whole, cut = whole_and_cut(table(spark, sf_dir, "documents"))
    digests = whole.select("doc_id", "_t", "_u", "n_words", F.sha2("_whole", 256).alias("_sha"))
    cuts = cut.select("_t", "_u", "copies", "n_removed", F.sha2("kept", 256).alias("_cut_sha"))
    joined = hot_join(digests, cuts, ["_t", "_u"], "copies", ["doc_id"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("_cut_sha", "_sha").alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) u(i)),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM repeated),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS t
  FROM (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
