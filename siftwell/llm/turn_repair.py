"""Operator 13: repair of conversations by aligning their turns to the grammar (s?(ua)+)?.

Faults are found turn by turn; then a conversation's role initials are aligned to the grammar's strings by Wagner and
Fischer's table. All strings of one length are one string, and read from its end the string of length r is the same
whatever it is the end of, so one table (turns left, letters left) serves all feasible lengths, with or without "s" in
front. Costs of a cheap repair found in one pass bound the table to Ukkonen's band about its diagonal. Where several
lengths are cheapest, their audits are traced back side by side, letter by letter, and the ASCII-least stays.

Turns are dealt by conversation and sorted on disk: first without their texts, for the alignment, then with them, so
that texts pass as a stream. In memory are two bytes and a digest for each turn of one conversation, some rows of the
table, and a block of it between them when it is traced. The time for a conversation is its turns times its faults.

Defined results: null roles and texts are one space; null turns come first; rows with a null conv_id form one
conversation; turns with the same number are ordered by role, then by a digest of role and text. A role that is not
"user" or "assistant" but has the initial wanted is kept as it is. Empty tables give no rows; other columns may have any
names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import SPACE, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # fixed values: what edits cost
ROLES = {"u": "user", "a": "assistant"}
FINE, CUT, DROPPED = 0, 1, 2  # a turn as the alignment sees it: whole, truncated, to be deleted
FAR = 1 << 29
KEPT_CELLS = 1 << 22  # of a table: above, only some rows are kept and the others are made again
FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _cheap_repair(initials: Sequence[str], kinds: Sequence[int]) -> int:
    """Cost of a repair found in one pass: a wrong next letter is mended by an insertion, a letter of no use by a new role."""
    cost, wanted, begun = 0, "u", False
    for initial, kind in zip(initials, kinds, strict=True):
        if kind == DROPPED:
            cost += DELETE
            continue
        cost += TRUNCATED * (kind == CUT)
        if initial == "s" and not begun:
            begun = True
            continue
        begun = True
        if initial not in ROLES:
            cost += REROLE
            wanted = "a" if wanted == "u" else "u"
        elif initial == wanted:
            wanted = "a" if wanted == "u" else "u"
        else:
            cost += INSERT  # the wanted letter; this turn comes behind it, and the same letter is wanted again
    if begun and wanted == "u" and not any(i != "s" and k != DROPPED for i, k in zip(initials, kinds, strict=True)):
        cost += 2 * INSERT  # nothing but the first "s"
    return min(cost + INSERT * (wanted == "a"), DELETE * len(kinds))


class _Table:
    """cost(i, r): cheapest way from turns i.. to the last r letters of "uaua...ua", inside the band."""

    def __init__(self, initials: Sequence[str], kinds: Sequence[int], incumbent: int) -> None:
        self.n, self.initials, self.kinds = len(kinds), initials, kinds
        least = sum(DELETE if k == DROPPED else TRUNCATED * (k == CUT) for k in kinds)
        self.half = max(incumbent - least, 0) // 2  # each letter more or less than turns costs two at least
        self.left = np.zeros(self.n + 1, np.int64)  # turns from i on that may stay
        self.left[:-1] = np.cumsum(np.array([k != DROPPED for k in kinds], np.int64)[::-1])[::-1]
        self.width = 2 * self.half + 1
        self.step = 1 if self.n * self.width <= KEPT_CELLS else int(np.sqrt(self.n)) + 1
        self.rows: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        self.slope = INSERT * np.arange(self.width)
        letters = np.arange(self.width) - self.half
        row = np.where(letters < 0, FAR, INSERT * letters)
        self.starts: list[tuple[int, int]] = []  # (cost, i): "s" is turn i, those before it are deleted
        for i in range(self.n, -1, -1):
            if i < self.n:
                if initials[i] == "s" and kinds[i] != DROPPED and (cost := self.cheapest(i + 1, row)[0]) < FAR:
                    self.starts.append((DELETE * i + TRUNCATED * (kinds[i] == CUT) + cost, i))
                row = self.above(i, row)
            if i % self.step == 0 or i == self.n:
                self.rows[i] = row
        self.row0 = row

    def above(self, i: int, row: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        if self.kinds[i] == DROPPED:
            return np.minimum(row + DELETE, FAR)
        odd = (np.arange(self.width) + self.left[i] - self.half) % 2 == 1
        wrong = np.where(odd, self.initials[i] != "a", self.initials[i] != "u")
        best = row + REROLE * wrong + TRUNCATED * (self.kinds[i] == CUT)
        best[:-1] = np.minimum(best[:-1], row[1:] + DELETE)
        return np.minimum(np.minimum.accumulate(best - self.slope) + self.slope, FAR)

    def cheapest(self, i: int, row: np.ndarray) -> tuple[int, list[int]]:
        """Least cost of row i over even numbers of letters, two at least, and the numbers that have it."""
        letters = np.arange(self.width) + self.left[i] - self.half
        costs = np.where((letters >= 2) & (letters % 2 == 0), row, FAR)
        return int(costs.min()), letters[costs == costs.min()].tolist()

    def row(self, i: int) -> np.ndarray:
        """Row i; rows are asked for in ascending order."""
        if i in self.rows:
            return self.rows[i]
        if i not in self.block:
            end = min(i - i % self.step + self.step, self.n)
            row, self.block = self.rows[end], {}
            for at in range(end - 1, i - 1, -1):
                row = self.block[at] = self.above(at, row)
        return self.block[i]

    def costs(self, i: int, letters: np.ndarray) -> np.ndarray:
        at = letters - self.left[i] + self.half
        inside = (letters >= 0) & (at >= 0) & (at < self.width)
        return np.where(inside, self.row(i)[np.clip(at, 0, self.width - 1)], FAR)


def audit_of(initials: Sequence[str], kinds: Sequence[int]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, the ASCII-least audit of those of equal cost."""
    n = len(kinds)
    table_ = _Table(initials, kinds, _cheap_repair(initials, kinds))
    plain, lengths = table_.cheapest(0, table_.row0)
    best = min([DELETE * n, plain, *(cost for cost, _ in table_.starts)])
    # what is still open: letters left, or the turn that becomes "s" and the letters left behind it
    letters = np.array(([0] if best == DELETE * n else []) + (lengths if plain == best else []), np.int64)
    waiting = [(i, table_.cheapest(i + 1, table_.row(i + 1))[1]) for cost, i in reversed(table_.starts) if cost == best]
    audit: list[str] = []
    i = 0
    while i < n or letters.any():
        moves: dict[str, np.ndarray] = {}
        if len(letters):
            now = table_.costs(i, letters)
            if i < n:
                deleted = now == table_.costs(i + 1, letters) + DELETE
                inserted = ~deleted & (now == table_.costs(i, letters - 1) + INSERT)
                same = np.where(letters % 2 == 1, initials[i] == "a", initials[i] == "u")
                moves = {"D": deleted, "I": inserted, "K": ~deleted & ~inserted & same, "R": ~deleted & ~inserted & ~same}
            else:
                moves = {"I": letters > 0}
        behind = [w for w in waiting if w[0] > i]
        starting = [w for w in waiting if w[0] == i]
        open_ = [m for m, which in moves.items() if which.any()] + ["D"] * bool(behind) + ["K"] * bool(starting)
        move = min(open_)
        letters = letters[moves[move]] if move in moves else letters[:0]
        letters = letters - (move != "D")
        if move == "K" and starting:
            letters = np.unique(np.concatenate([letters, *(np.array(m, np.int64) for _, m in starting)]))
        waiting = behind if move == "D" else []
        audit.append(move)
        i += move != "I"
    return best, "".join(audit)


_audit_of_short = lru_cache(100_000)(audit_of)


class _Conversation:
    """One conversation as it passes: turns without texts, then its report, then turns with texts."""

    def __init__(self, conv: object) -> None:
        self.conv, self.initials, self.kinds = conv, [], []
        self.counts = dict.fromkeys(FAULTS, 0)
        self.seen: set[bytes] = set()
        self.first = self.last = None
        self.different = 0
        self.audit: str | None = None
        self.at = self.place = 0
        self.wanted = "u"

    def note(self, turn: int | None, initial: str, blank: bool, cut: bool, digest: bytes) -> None:
        c = self.counts
        if turn is not None:
            self.different += turn != self.last
            self.first, self.last = (turn if self.first is None else self.first), turn
        if self.initials:
            c["illegal"] += self.initials[-1] + initial not in ("su", "ua", "au")
        fault = "blank" if blank else "duplicate" if digest in self.seen else "truncated" if cut else None
        self.seen.add(digest)
        if fault:
            c[fault] += 1
        self.initials.append(initial)
        self.kinds.append(FINE if fault is None else CUT if fault == "truncated" else DROPPED)

    def report(self) -> tuple:
        solve = _audit_of_short if len(self.kinds) <= 64 else audit_of
        self.counts["cost"], self.audit = solve(tuple(self.initials), tuple(self.kinds))
        if self.first is not None:
            self.counts["gaps"] = self.last - self.first + 1 - self.different
        self.seen = set()
        return (self.conv, 0, None, None, None, *self.counts.values(), self.audit)

    def _made(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return (self.conv, self.place, edit, role, text, *[None] * (len(FAULTS) + 1))

    def _letter(self) -> str:
        letter, self.wanted = self.wanted, "a" if self.wanted == "u" else "u"
        return letter

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made("I", ROLES[self._letter()], "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._made(edit, ROLES[self._letter()], text)
        elif edit == "K":
            if self.place or role[:1] != "s":
                self._letter()
            yield self._made(edit, role, text)


def repair(df: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text, gaps, blank, duplicate, truncated, illegal, cost, audit. Place 0 is a
    conversation's report (counts, cost and audit; no turn), places from 1 on are its turns after repair (no report).
    df: conv_id, turn, role, text; rows whose _copies is 0 only say that there is such a conversation, and rows with more
    stand as often. Partitions hold whole conversations, sorted."""
    copies = F.col("_copies") if "_copies" in df.columns else F.lit(1)
    role, text = (F.coalesce(df[c], F.lit(" ")) for c in ("role", "text"))
    trimmed = F.rtrim(F.col("_text"), F.lit(SPACE))
    kinds = F.when(copies == 0, F.array(F.lit(-1))).otherwise(F.concat(F.array_repeat(F.lit(0), copies), F.array_repeat(F.lit(1), copies)))
    rows = df.select("conv_id", "turn", role.alias("_role"), text.alias("_text"), kinds.alias("_kinds")).select(
        "conv_id", "turn", "_role", "_text", F.explode("_kinds").alias("_kind"),
        F.unhex(F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"))).alias("_digest"),
        (trimmed == "").alias("_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("_cut"),
    ).withColumn("_text", F.when(F.col("_kind") == 1, F.col("_text")))
    dealt = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", "_kind", F.col("turn").asc_nulls_first(), "_role", "_digest"
    )
    conv_type = df.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "role", "text", *FAULTS, "audit"]

    def batch_of(done: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        types = [conv, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(FAULTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None

        def ended() -> list[tuple]:
            return ([now.report()] if now.audit is None else []) + list(now.inserted())

        for batch in batches:
            done: list[tuple] = []
            columns = ("conv_id", "_kind", "turn", "_role", "_text", "_digest", "_blank", "_cut")
            for conv, kind, turn, role, text, digest, blank, cut in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None or conv != now.conv:
                    done += ended() if now else []
                    now = _Conversation(conv)
                if kind == 0:
                    now.note(turn, role[:1], blank, cut, digest)
                elif kind == 1:
                    if now.audit is None:
                        done.append(now.report())
                    done += now.turn(role, text)
            if done:
                yield batch_of(done, batch.schema.field("conv_id").type)
            last = batch.schema.field("conv_id").type
        if now and (done := ended()):
            yield batch_of(done, last)

    schema = f"conv_id {conv_type}, place bigint, edit string, role string, text string, {', '.join(f'{c} bigint' for c in FAULTS)}, audit string"
    return dealt.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its report and repaired_sha256 over role:text of its turns, joined by line breaks. Takes
    what repair returns, in its partitions and order."""
    conv_type = repaired.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *FAULTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = conv_kind = None
        for batch in batches:
            done = []
            conv_kind = batch.schema.field("conv_id").type
            report = [batch.column(c).to_pylist() for c in ("conv_id", *FAULTS, "audit")]
            turns = (batch.column(c).to_pylist() for c in ("place", "role", "text"))
            for i, (place, role, text) in enumerate(zip(*turns, strict=True)):
                if place == 0:
                    done += [(*now, state.hexdigest())] if now else []
                    now, state = tuple(c[i] for c in report), hashlib.sha256()
                else:
                    state.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if done:
                yield batch_of(done, conv_kind)
        if now:
            yield batch_of([(*now, state.hexdigest())], conv_kind)

    def batch_of(done: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        types = [conv, *[pa.int64()] * len(FAULTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    schema = f"conv_id {conv_type}, {', '.join(f'{c} bigint' for c in FAULTS)}, audit string, repaired_sha256 string"
    return repaired.mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _copies: of twenty rows one is dropped, one emptied, one loses its sentence ends, one
    is repeated and one becomes the user's, as its conversation and turn say. Nulls are one space."""
    def known(c: str) -> Column:
        return F.coalesce(df[c].cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    return df.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("_copies"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))
