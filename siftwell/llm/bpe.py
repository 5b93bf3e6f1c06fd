"""Operator 4: byte-level BPE encoding and decoding by an index from pairs to their positions.

A partition is worked through in pieces of some MB. The pieces' new pre-tokens lie side by side as one sequence of
symbols; an index maps the rank of each adjacent pair to all its positions. The active ranks are applied in ascending
order; a merge changes the lists of the two pairs beside it only. Pre-tokens that were met before come from a cache of
bounded size, which is emptied when it is full, so that results never depend on it.

Defined results: null text is empty text; empty text has no ids and decodes to empty text. The string of a special
token inside a text is that token. Texts of any length are encoded whole. Repeated rows give equal rows. The operators
return the columns asked for and their own; other columns may have any names, the operator's own included. Bytes that
are no UTF-8 decode to U+FFFD."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import slices, table

# Fixed value: how byte-level BPE parts a text before it merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 20  # ids are below 2 ** SHIFT
CACHE_WORDS = 300_000  # pre-tokens, and stretches between blanks, that one Python worker remembers
SPECIAL, BARE, FIRST = "\ud800", "\ud801", "\ud802"  # marks in front of a cached string; they cannot occur in a text


@dataclass
class Vocabulary:
    """Merges by pair of ids, ids of single bytes, bytes of ids, special tokens."""

    ranks: dict[int, int]  # left << SHIFT | right -> rank
    pairs: list[tuple[int, int, int]]  # left, right and merged id of each rank
    keys: np.ndarray  # the keys of ranks, sorted
    key_ranks: np.ndarray  # their ranks
    byte_ids: list[int]
    token_bytes: dict[int, bytes]
    special: dict[str, int]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library, read on the driver (its size does not grow with the data)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], _byte_letters()
    byte_of = {letter: b for b, letter in enumerate(letters)}
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    token_bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items() if token not in special}
    token_bytes |= {i: token.encode() for token, i in special.items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    ranks = {left << SHIFT | right: rank for rank, (left, right, _) in enumerate(merges)}
    keys = np.array(list(ranks), np.int64)
    order = np.argsort(keys)
    key_ranks = np.array(list(ranks.values()), np.int64)[order]
    return Vocabulary(ranks, merges, keys[order], key_ranks, [ids[letter] for letter in letters], token_bytes, special)


def merge_words(words: Sequence[bytes], vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
    """Ids of all words, one after the other, and how many each word has."""
    if not words:
        return [], []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    plain = np.array(vocabulary.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.insert(plain, np.cumsum(lengths), -1)  # no merge crosses a -1
    keys = flat[:-1] << SHIFT | flat[1:]
    at = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
    here = np.flatnonzero((vocabulary.keys[at] == keys) & (flat[:-1] >= 0) & (flat[1:] >= 0))
    rank_here = vocabulary.key_ranks[at[here]]
    order = np.argsort(rank_here, kind="stable")
    here, rank_here = here[order], rank_here[order]
    first = np.flatnonzero(np.concatenate([[True], rank_here[1:] != rank_here[:-1]])) if len(here) else np.empty(0, np.int64)
    cut = [*first.tolist(), len(here)]
    positions = here.tolist()
    active = rank_here[first].tolist()  # ascending, so it is a heap
    # rank of a pair -> where its left symbol stands
    places = {rank: positions[cut[i] : cut[i + 1]] for i, rank in enumerate(active)}
    symbols = flat.tolist()
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    rank_of, pairs, dead = vocabulary.ranks.get, vocabulary.pairs, -2
    while active:
        rank = heapq.heappop(active)
        left, right, merged = pairs[rank]
        for at_left in sorted(places.pop(rank)):
            if symbols[at_left] != left or symbols[at_right := after[at_left]] != right:
                continue  # an earlier merge has taken one of the two
            symbols[at_left], symbols[at_right] = merged, dead
            end = after[at_left] = after[at_right]
            before[end] = at_left
            beside = before[at_left]
            if beside >= 0 and (new := rank_of(symbols[beside] << SHIFT | merged)) is not None:
                if new in places:
                    places[new].append(beside)
                else:
                    places[new] = [beside]
                    heapq.heappush(active, new)
            if (new := rank_of(merged << SHIFT | symbols[end])) is not None:
                if new in places:
                    places[new].append(at_left)
                else:
                    places[new] = [at_left]
                    heapq.heappush(active, new)
    done = np.array(symbols, np.int64)
    upto = np.cumsum(done >= 0)[done == -1]
    return done[done >= 0].tolist(), np.diff(upto, prepend=0).tolist()


@dataclass
class _Store:
    """Strings met so far: number, ids."""

    numbers: dict[str, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def unknown(self, rows: list[list[str]]) -> list[str]:
        return [w for w in dict.fromkeys(w for row in rows for w in row) if w not in self.numbers]

    def add(self, new: list[str], flat: Sequence[int], counts: Sequence[int]) -> None:
        known = len(self.numbers)
        self.numbers.update((w, known + i) for i, w in enumerate(new))
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(counts, np.int64))])

    def ids(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and where each row ends (with a leading 0)."""
        number = self.numbers.__getitem__
        words = np.fromiter((number(w) for row in rows for w in row), np.int64, sum(map(len, rows)))
        first, sizes = self.ends[words], np.diff(self.ends)[words] if len(words) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)]


class _Encoder:
    """A blank begins a pre-token or ends white space, unless white space is on both sides of it. So texts are cut at
    blanks, and only stretches that were not met before are parted into pre-tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words, self.stretches = _Store(), _Store()
        self.split = regex.compile(PRE_TOKENS).findall
        self.blank_amid_space = regex.compile(r"\s \s").search
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def parts(self, text: str) -> list[str]:
        if self.special is not None and self.special.search(text):
            found: list[str] = []
            for number, part in enumerate(self.special.split(text)):
                found += [SPECIAL + part] if number % 2 else [BARE + w for w in self.split(part)]
            return found
        if self.blank_amid_space(text):
            return [BARE + w for w in self.split(text)]
        found = text.split(" ")
        found[0] = FIRST + found[0]
        return found

    def words_of(self, stretch: str) -> list[str]:
        mark = stretch[:1]
        if mark == SPECIAL:
            return [stretch]
        if mark == BARE:
            return [stretch[1:]]
        return self.split(stretch[1:] if mark == FIRST else " " + stretch)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text ends (with a leading 0)."""
        rows = [self.parts(text) for text in texts]
        self.words, self.stretches = (_Store() if len(s.numbers) > CACHE_WORDS else s for s in (self.words, self.stretches))
        if new := self.stretches.unknown(rows):
            parted = [self.words_of(stretch) for stretch in new]
            if unknown := self.words.unknown(parted):
                plain, marked = ([w for w in unknown if (w[0] == SPECIAL) == yes] for yes in (False, True))
                flat, counts = merge_words([w.encode() for w in plain], self.vocabulary)
                flat += [self.vocabulary.special[w[1:]] for w in marked]
                self.words.add(plain + marked, flat, counts + [1] * len(marked))
            ids, ends = self.words.ids(parted)
            self.stretches.add(new, ids, np.diff(ends))
        return self.stretches.ids(rows)


def encode(df: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns + ids array<int>."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [df[c].alias(f"_{i}") for i, c in enumerate(keep)]
    rows = df.select(*kept, F.coalesce(df[text], F.lit("")).alias("_text"))
    names = [f"_{i}" for i in range(len(keep))]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(shared.value)
        for piece in slices(batches, "_text"):
            ids, ends = encoder.encode(piece.column("_text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), lists], [*names, "_ids"])

    return rows.mapInArrow(run, schema).toDF(*keep, "ids")


def decode(df: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns + decoded string; null ids decode to empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.token_bytes)
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(*(df[c].alias(n) for c, n in zip(keep, names, strict=True)), df[ids].alias("_ids"))
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                column = piece.column("_ids")
                texts = [
                    b"".join(map(get, row.values.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace")
                    if row.is_valid
                    else ""
                    for row in column
                ]
                arrays = [*(piece.column(c) for c in names), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "_decoded"])

    return rows.mapInArrow(run, schema).toDF(*keep, "decoded")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    vocabulary = load_vocabulary(default_path())
    encoded = encode(table(spark, sf_dir, "documents"), vocabulary)
    digests = encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    back = decode(digests, vocabulary, ("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
