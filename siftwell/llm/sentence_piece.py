"""Operator 11: SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

The words of a piece of some MB that were not met before lie side by side in one flat numpy array of symbols. A round
looks up the rank of each adjacent pair, takes the least rank of each word (a segmented minimum), merges its leftmost
occurrences that don't overlap in all words at once, and closes the gaps; words without a pair leave. Rounds end when
none is left. Merging several occurrences at once is what one after the other gives, unless a merge makes a pair that
ranks no worse than itself; the vocabulary tells which merges may, and for those only the leftmost of a word is taken.

Blanks begin words, since no symbol has a blank behind another letter, and words are cut where two letters stand side by
side in no symbol. Words that were met before come from a cache of bounded size, which is emptied when it is full, so
that results never depend on it.

Defined results: null text is empty text; empty text has no ids and decodes to empty text. A blank and U+2581 are the
same letter, as in the library, so U+2581 decodes to a blank. Names of control symbols in a text are ordinary letters.
Texts of any length are encoded whole. Repeated rows give equal rows, an empty table none. The operators return the
columns asked for and their own; other columns may have any names, the operator's own included. Null ids decode to
empty text, bytes that are no UTF-8 to U+FFFD each, control symbols to nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import slices, table

BLANK = "▁"  # how a blank is written in symbols
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: the kinds of symbols in a model file
SHIFT = 21  # letters that are no symbols have ids up to 32 000 + 0x10FFFF
NONE = np.iinfo(np.int32).max
CACHE_WORDS = 400_000  # words that one Python worker remembers


@dataclass
class Pieces:
    """The merges of a model as sorted pairs, its letters, and the bytes of its symbols."""

    size: int
    pairs: np.ndarray  # left << SHIFT | right, sorted
    ranks: np.ndarray  # of each pair
    merged: np.ndarray  # symbol that each pair becomes
    alone: np.ndarray  # whether that merge may make a pair that ranks no worse
    letters: dict[str, int]  # letters that are symbols
    neighbours: np.ndarray  # pairs of letters that stand side by side in a symbol, sorted
    byte_ids: list[int]
    token_bytes: list[bytes]
    normal: list[bool]
    silent: list[int]  # control symbols
    cuts: str  # white space that is in no symbol


def load_pieces(path: str) -> Pieces:
    """A BPE model of the sentencepiece library, read on the driver (its size does not grow with the data). Only what
    public models of this kind have: no change of letters, a blank before the text, byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    plain = rules.add_dummy_prefix and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    if not plain or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: not a plain BPE model with byte fallback")
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
    if any(BLANK in piece.lstrip(BLANK) for piece in ids):
        raise ValueError(f"{path}: a symbol has a blank behind another letter")
    size = len(model.pieces)
    of_score = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}

    def symbol(part: str) -> int | None:
        return ids.get(part, size + ord(part) if len(part) == 1 else None)

    rows = [
        (left << SHIFT | right, of_score[model.pieces[i].score], i)
        for piece, i in ids.items()
        for at in range(1, len(piece))
        if (left := symbol(piece[:at])) is not None and (right := symbol(piece[at:])) is not None
    ]
    pairs, ranks, merged = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
    best = np.full(size + 0x110000, NONE, np.int64)  # best rank of a pair that a symbol is in
    np.minimum.at(best, pairs >> SHIFT, ranks)
    np.minimum.at(best, pairs & ((1 << SHIFT) - 1), ranks)
    beside = {symbol(a) << SHIFT | symbol(b) for piece in ids for a, b in zip(piece, piece[1:], strict=False)}
    byte_ids = [i for _, i in sorted((int(p.piece[3:5], 16), i) for i, p in enumerate(model.pieces) if p.type == BYTE)]
    used = {c for piece in ids for c in piece}
    bytes_of = {
        NORMAL: lambda p: p.piece.replace(BLANK, " ").encode(),
        UNKNOWN: lambda p: model.trainer_spec.unk_surface.encode(),
        CONTROL: lambda p: b"",
        BYTE: lambda p: bytes([int(p.piece[3:5], 16)]),
    }
    return Pieces(
        size, pairs, ranks.astype(np.int32), merged, best[merged] <= ranks,
        {c: ids[c] for c in ids if len(c) == 1}, np.array(sorted(beside), np.int64), byte_ids,
        [bytes_of[p.type](p) for p in model.pieces], [p.type == NORMAL for p in model.pieces],
        [i for i, p in enumerate(model.pieces) if p.type == CONTROL],
        "".join(c for c in "\t\n\r" if c not in used),
    )


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand among the sorted ones, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def merge_rounds(symbols: np.ndarray, words: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges and the word of each. words: ascending numbers; no merge crosses two words."""

    def ranks_at(at: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each place, NONE behind the last symbol of a word."""
        at = at[at < len(symbols) - 1]
        place, known = _places(pieces.pairs, symbols[at] << SHIFT | symbols[at + 1])
        return np.where(known & (words[at] == words[at + 1]), pieces.ranks[place], NONE)

    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.full(len(symbols), NONE, np.int32)
    rank[:-1] = ranks_at(np.arange(len(symbols) - 1))
    while len(symbols):
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        open_ = np.repeat(least < NONE, sizes)
        if not open_.all():
            done.append((symbols[~open_], words[~open_]))
            symbols, words, rank = symbols[open_], words[open_], rank[open_]
            least, sizes = least[least < NONE], sizes[least < NONE]
            if not len(symbols):
                break
        here = np.flatnonzero(rank == np.repeat(least, sizes))
        run = np.concatenate([[True], np.diff(here) > 1])  # places side by side share a symbol: every other one is merged
        in_run = np.arange(len(here)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(here))))
        here = here[in_run % 2 == 0]
        place = np.searchsorted(pieces.pairs, symbols[here] << SHIFT | symbols[here + 1])
        if (alone := pieces.alone[place]).any():
            first = np.concatenate([[True], np.diff(words[here]) > 0])
            kept = first | ~np.isin(words[here], words[here[alone]])
            here, place = here[kept], place[kept]
        symbols[here] = pieces.merged[place]
        left = np.ones(len(symbols), bool)
        left[here + 1] = False
        symbols, words, rank = symbols[left], words[left], rank[left]
        here = here - np.arange(len(here))  # each merge has moved those behind it by one
        for at in (here, here[here > 0] - 1):
            at = at[at < len(symbols) - 1]
            rank[at] = ranks_at(at)
        rank[-1] = NONE
    if not done:
        return symbols, words
    symbols, words = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(words, kind="stable")
    return symbols[order], words[order]


def encode_words(texts: Sequence[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds, which = np.unique(codes, return_inverse=True)
    known = [pieces.letters.get(BLANK if c == 32 else chr(c), pieces.size + c) for c in kinds.tolist()]
    symbols = np.array(known, np.int64)[which]
    owner = np.repeat(np.arange(len(texts)), lengths)
    _, joined = _places(pieces.neighbours, symbols[:-1] << SHIFT | symbols[1:])
    parts = np.concatenate([[0], np.cumsum(~joined | (owner[1:] != owner[:-1]))])
    part_owner = owner[np.flatnonzero(np.concatenate([[True], np.diff(parts) > 0]))]
    merged, part = merge_rounds(symbols, parts, pieces)
    owner = part_owner[part]
    if (foreign := merged >= pieces.size).any():  # letters that are no symbols become the ids of their bytes
        written = {c: [pieces.byte_ids[b] for b in chr(c - pieces.size).encode()] for c in np.unique(merged[foreign]).tolist()}
        rows = [written[c] for c in merged[foreign].tolist()]
        times = np.ones(len(merged), np.int64)
        times[foreign] = [len(r) for r in rows]
        merged, owner, spread = np.repeat(merged, times), np.repeat(owner, times), np.repeat(foreign, times)
        merged[spread] = [b for r in rows for b in r]
    return merged, np.bincount(owner, minlength=len(texts))


@dataclass
class _Encoder:
    """Words met so far: number, ids."""

    pieces: Pieces
    numbers: dict[str, int] = field(default_factory=dict)
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def __post_init__(self) -> None:
        cuts = self.pieces.cuts
        self.split = re.compile(rf" +[^ {cuts}]*|[^ {cuts}]+|[{cuts}]+" if cuts else " +[^ ]*").findall

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text ends (with a leading 0)."""
        rows = [self.split(" " + text.replace(BLANK, " ")) if text else [] for text in texts]
        if len(self.numbers) > CACHE_WORDS:
            self.numbers, self.flat, self.ends = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        new = [w for w in dict.fromkeys(w for row in rows for w in row) if w not in self.numbers]
        if new:
            flat, counts = encode_words(new, self.pieces)
            known = len(self.numbers)
            self.numbers.update((w, known + i) for i, w in enumerate(new))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        number = self.numbers.__getitem__
        words = np.fromiter((number(w) for row in rows for w in row), np.int64, sum(map(len, rows)))
        first, sizes = self.ends[words], np.diff(self.ends)[words]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ids = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)]


def _runs_decoded(ids: list[int], pieces: Pieces) -> str:
    """Runs of byte symbols letter by letter, each wrong byte as U+FFFD; a control symbol ends a run."""
    out, held = [], b""
    byte_ids = set(pieces.byte_ids)
    for i in [*ids, None]:
        if i in byte_ids:
            held += pieces.token_bytes[i]
            continue
        at = 0
        while at < len(held):
            for n in (1, 2, 3, 4):
                try:
                    out.append(held[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        held = b""
        out += [] if i is None else [pieces.token_bytes[i].decode()]
    return "".join(out)


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of ids; the blank that encoding has put before a text is taken away."""
    get = pieces.token_bytes.__getitem__
    try:
        text = None if any(i in ids for i in pieces.silent) else b"".join(map(get, ids)).decode()
    except UnicodeDecodeError:
        text = None
    text = _runs_decoded(ids, pieces) if text is None else text
    first = next((i for i in ids if get(i)), None)
    return text[1:] if first is not None and pieces.normal[first] and get(first)[:1] == b" " else text


def encode(df: DataFrame, pieces: Pieces, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns + ids array<int>."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    names = [f"_{i}" for i in range(len(keep))]
    kept = [df[c].alias(n) for c, n in zip(keep, names, strict=True)]
    rows = df.select(*kept, F.coalesce(df[text], F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(shared.value)
        for part in slices(batches, "_text"):
            ids, ends = encoder.encode(part.column("_text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists], [*names, "_ids"])

    return rows.mapInArrow(run, schema).toDF(*keep, "ids")


def decode(df: DataFrame, pieces: Pieces, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns + decoded string."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    names = [f"_{i}" for i in range(len(keep))]
    rows = df.select(*(df[c].alias(n) for c, n in zip(keep, names, strict=True)), df[ids].alias("_ids"))
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("_decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [
                    decode_ids(row.values.to_numpy(zero_copy_only=False).tolist(), shared.value) if row.is_valid else ""
                    for row in part.column("_ids")
                ]
                arrays = [*(part.column(c) for c in names), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "_decoded"])

    return rows.mapInArrow(run, schema).toDF(*keep, "decoded")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    pieces = load_pieces(default_path())
    encoded = encode(table(spark, sf_dir, "documents"), pieces)
    digests = encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    back = decode(digests, pieces, ("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
