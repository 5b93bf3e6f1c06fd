"""SentencePiece against its library; the prefix trie and the repair of turns against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from siftwell.llm import prefix_trie, sentence_piece, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


# --- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentence_piece.load_pieces(sentence_piece.default_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_piece.default_path())


def odd_texts(library):
    rng = random.Random(3)
    letters = "ab  é\n\t\r 'sthelo<s>1２٣!?$  \x1c\x85​漢字😀ñ\x00▁aaaa"
    symbols = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["", " ", "  ", "a" * 5000, "<s>", "▁", "\n", "word " * 20000, "ab" * 3000, "0123456789abcdef" * 500, "=" * 777]
    for signs, most in ((letters, 60), (symbols, 30), ("abcdefghijklmnopqrstuvwxyz", 200), ("aeth ", 200), ("=-_ #", 100)):
        texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, most))) for _ in range(2000)]
    return texts


def test_ids_equal_the_library(pieces, library):
    texts = odd_texts(library)
    wanted, encoder = library.encode(texts), sentence_piece._Encoder(pieces)
    for _ in range(2):  # the second time words come from the cache
        ids, ends = encoder.encode(texts)
        assert all(ids[ends[i] : ends[i + 1]].tolist() == w for i, w in enumerate(wanted))
    assert all(sentence_piece.decode_ids(w, pieces) == library.decode(w) for w in wanted)


def test_a_full_cache_changes_nothing(pieces, library, monkeypatch):
    monkeypatch.setattr(sentence_piece, "CACHE_WORDS", 3)
    encoder = sentence_piece._Encoder(pieces)
    for text in ("one two three four", "one two five six", "", "one  two"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_any_ids_decode_as_in_the_library(pieces, library):
    rng = random.Random(5)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(259), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert sentence_piece.decode_ids(ids, pieces) == library.decode(ids)


def test_rows_with_nulls_and_clashing_names(spark, pieces, library):
    rows = [(1, None, 7, "s"), (2, "", 7, "s"), (2, "", 7, "s"), (None, "x  y", 7, "s"), (4, "ab " * 30000, 7, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, _ids string")
    encoded = sentence_piece.encode(df, pieces, ("doc_id", "ids", "_ids", "text"))
    assert encoded.columns == ["doc_id", "ids", "_ids", "text", "ids"]
    encoded = sentence_piece.encode(df, pieces, ("doc_id", "text"))
    found = encoded.collect()
    assert sorted(map(str, [r.ids for r in found])) == sorted(map(str, [library.encode(t or "") for _, t, *_ in rows]))
    assert all(r.decoded == (r.text or "") for r in sentence_piece.decode(encoded, pieces, ("text",)).collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [pieces.byte_ids[0xE9]])], "doc_id long, ids array<int>")
    assert [r.decoded for r in sentence_piece.decode(odd, pieces).orderBy("doc_id").collect()] == ["", "", "�"]
    assert sentence_piece.encode(df.limit(0), pieces).count() == 0


# --- prefix trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(set)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].add(p)
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1] if p else "")) for p, m in members.items()}
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), sum(len(q) == len(p) + 1 for q in below[p]),
            sum(len(below[q]) == 1 for q in below[p]), sum(saved[q] for q in below[p]),
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def trie_found(df, split=prefix_trie.SPLIT_NODES):
    found = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.turns_of(df)), split).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in found)


def test_trie_by_hand(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(["a b", "c", None, "", "é f  g"])) for c in rng.sample(range(300), 150) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", "same again") for c in range(400, 520) for t in range(3)]  # many copies
    rows += [(c, None, "user", "x") for c in range(200, 210)] + [(7, 0, "user", "twice"), (7, 0, "user", "twice"), (None, 0, "user", "n")]
    rows += [(1003, 0, "user", "alone")]  # keeps nothing of its own, and its block has no first conversation
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, n_convs string").repartition(5)
    wanted = trie_by_hand(rows)
    assert trie_found(df) == wanted
    assert trie_found(df, 20) == wanted  # components are split by joins
    assert trie_found(df.limit(0)) == []


def test_long_conversations(spark):
    """A conversation of a third of all rows goes through many partitions; its path is halved again and again."""
    turns = [(f"t{i}" if i % 97 else "start", i) for i in range(900)]
    rows = [(0, i, "user", t) for t, i in turns] + [(1, i, "user", t) for t, i in turns[:700]] + [(2, i, "user", t) for t, i in turns]
    rows += [(c, i, "user", f"o{c} {i}") for c in range(3, 300) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert trie_found(df, 100) == trie_by_hand(rows)


def test_forests_of_any_shape():
    rng = random.Random(4)
    for _ in range(60):
        parent, depth = [], []
        for tree in range(rng.randint(1, 4)):
            first = len(parent)
            tops = [(-1, 0)]
            for i in range(1, rng.randint(1, 60)):
                at = rng.choice([i - 1, rng.randrange(i)])
                tops.append((at, tops[at][1] + 1))
            order = sorted(range(len(tops)), key=lambda i: (tops[i][1], i))
            place = {old: first + new for new, old in enumerate(order)}
            parent += [place[tops[i][0]] if tops[i][0] >= 0 else -1 for i in order]
            depth += [tops[i][1] for i in order]
        values = np.array([[rng.randint(0, 9), 1] for _ in parent], np.int64)
        wanted = values.copy()
        for i in sorted(range(len(parent)), key=lambda i: -depth[i]):
            if parent[i] >= 0:
                wanted[parent[i]] += wanted[i]
        found = prefix_trie.decompose(np.array(parent), np.array(depth), wanted[:, 1].copy(), values)
        assert (found == wanted).all()


# --- repair of turns


def cheapest_repair(initials, kinds):
    """Uniform-cost search over (turns read, last letter written), the least audit first."""
    n, heap, seen = len(kinds), [(0, "", 0, "0")], {}
    best = None
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if (i, state) in seen and seen[i, state] < (cost, audit) or len(audit) > 3 * n + 6:
            continue
        seen[i, state] = cost, audit
        if i == n and state in "0A" and (best is None or (cost, audit) < best):
            best = cost, audit
        letter = "a" if state == "U" else "u"
        steps = [(2, "I", i, letter.upper())]
        if i < n:
            steps.append((3, "D", i + 1, state))
            if kinds[i] != turn_repair.DROPPED:
                extra = int(kinds[i] == turn_repair.CUT)
                steps += [(extra, "K", i + 1, "S")] if state == "0" and initials[i] == "s" else []
                steps += [(extra, "K", i + 1, letter.upper())] if initials[i] == letter else []
                steps.append((2 + extra, "R", i + 1, letter.upper()))
        for more, edit, at, then in steps:
            heapq.heappush(heap, (cost + more, audit + edit, at, then))
    return best


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_audits_are_cheapest_and_least(cells, monkeypatch):
    monkeypatch.setattr(turn_repair, "KEPT_CELLS", cells)
    rng = random.Random(cells)
    for k in range(4000):
        n = rng.randint(0, 9)
        initials, kinds = [rng.choice(("suaua", "suax", "ua")[k % 3]) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        assert turn_repair.audit_of(initials, kinds) == cheapest_repair(initials, kinds)


def test_rows_kept_or_made_again_give_one_audit(monkeypatch):
    rng = random.Random(9)
    initials = ["ua"[i % 2] if rng.random() > 0.1 else rng.choice("uas") for i in range(3000)]
    kinds = [rng.choice([0] * 17 + [1, 2, 2]) for _ in initials]
    kept = turn_repair.audit_of(initials, kinds)
    monkeypatch.setattr(turn_repair, "KEPT_CELLS", 1)
    assert turn_repair.audit_of(initials, kinds) == kept


def repaired_by_hand(rows):
    def shown(x):
        return " " if x is None else str(x)

    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        convs[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        counts, kinds, seen = defaultdict(int), [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            kinds.append({None: 0, "truncated": 1}.get(fault, 2))
        initials = [role[:1] for _, role, _ in turns]
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest_repair(initials, kinds)
        lines, at = [], 0
        for edit in audit:
            wanted = ("user", "assistant")[(len(lines) - bool(lines and lines[0][:1] == "s")) % 2]
            role, text = turns[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit != "D":
                lines.append(f"{wanted if edit in 'IR' else role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_repair_by_hand(spark):
    rng = random.Random(8)
    words = ["Yes.", "No!", "well", " ", None, "", "a\nb.", "What? ", "end\x0b", "é…"]
    rows = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(words)) for c in range(400) for t in range(rng.randint(1, 9))]
    rows += [(c, 0, "system", "Be brief.") for c in range(400, 440)] + [(450, None, None, None), (450, None, "", "x."), (None, 0, "user", "a."), (None, 3, "other", "b.")]
    rows += [(460, 1, "user", "same."), (460, 1, "user", "same."), (460, 1, "assistant", "same.")]
    # rows that are all dropped
    rows += [(c, 0, "user", "gone.") for c in range(500, 700) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", place int, _kind string").repartition(3)
    repaired = turn_repair.repair(turn_repair.damaged(df))
    found = sorted((tuple(r) for r in turn_repair.digests(repaired).collect()), key=str)
    assert found == repaired_by_hand(rows)
    assert any(r[7] == "" for r in found)
    kept = repaired.where("place > 0").collect()
    roles = defaultdict(list)
    for r in sorted(kept, key=lambda r: r.place):
        roles[r.conv_id].append(r.role[:1])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in roles.values())
    assert turn_repair.digests(turn_repair.repair(turn_repair.damaged(df.limit(0)))).count() == 0
    plain = turn_repair.digests(turn_repair.repair(df.where("conv_id = 460").drop("_kind"))).collect()
    assert [r.duplicate for r in plain] == [1]
