"""Faster forms against the plain ones they stand for."""

import random

import pytest
from pyspark.sql import functions as F
from siftwell.functions import masks, patterns as P, style
from siftwell.functions.text import words
from siftwell.operators import censor, classwords, features, neighbours, ngrams, trees
from siftwell.plans import train_eval
from siftwell.sources import mailbox

TEXTS = [
    None, "", " ", "a", "a\nb", "a\r\nb\r\n", "a\n\n", "\n\n", "a\rb\n", " ENTERNEWLINEENDVAR  b", "a ENTERNEWLINEENDVAR ENTERNEWLINEENDVAR b",
    "aENTERNEWLINEENDVAR b ENTERNEWLINEENDVARc ENTERNEWLINEENDVAR  d", "x MAILSUBJECTENDVAR  ENTERNEWLINEENDVAR  y ENTERNEWLINEENDVAR  ",
    "\u05e9\u05dc\u05d5\u05dd \u00e9\u00d7\u00f7 z\u3000LINK12ENDVAR EMAILENDVAR PHONENUMBER1ENDVAR ENTERNEWLINEENDVAR  q\U0001f600!", "LINK PHONENUMBER EMOJI ENDVAR",
]


def test_faster_patterns_count_the_same(frame):
    df = frame(list(enumerate(TEXTS)), "i int, text string")
    t = F.col("text")
    plain = F.regexp_replace(t, f"{P.CHAR}*{P.END}{P.CHAR}*", " ")
    breaks = f"(?:{P.NEWLINE}|{P.SUBJECT}){P.END}"
    sentences = f"(?<!{P.CHAR})(?!{breaks}){P.WORD}{P.SPACE}+{P.NEWLINE}{P.END}"
    latin = P.SCRIPTS["latin"]
    pairs = [
        (masks.mask_breaks(t), F.regexp_replace(F.regexp_replace(t, "\\r?\\n\\z", ""), "\\r?\\n", f" {P.NEWLINE}{P.END}  ")),
        (style.without_markers(t), plain),
        (style.sentence_count(t), 1 + F.regexp_count(t, F.lit(sentences))),
        (style._without(t, P.BESIDE_LATIN), F.regexp_count(t, F.lit(f"[{latin}]"))),
        (style._marker(t, P.LINK, "[0-9]+"), F.regexp_count(t, F.lit(f"(?<!{P.CHAR})LINK[0-9]+ENDVAR"))),
    ]
    for fast, slow in pairs:
        assert [r for r in df.select("text", fast.alias("a"), slow.alias("b")).collect() if r.a != r.b] == []
    found = style.add_style(df, script="latin")
    words = F.regexp_count(plain, F.lit(P.WORD)) + F.regexp_count(t, F.lit(f"(?<!{P.CHAR})(?:LINK[0-9]+|EMAIL|PHONENUMBER[0-9@]){P.END}"))
    letters = F.length(F.regexp_replace(plain, f"{P.SPACE}+", "")) + F.regexp_count(t, F.lit(f"(?<!{P.CHAR})EMOJI.{P.END}"))
    assert [r for r in found.select("text", "n_words", "n_letters", words.alias("a"), letters.alias("b")).collect() if (r.n_words, r.n_letters) != (r.a, r.b)] == []


@pytest.mark.parametrize("sparse", [False, True])
def test_neighbours_of_groups_and_frequent_slots(spark, sparse):
    rng = random.Random(5)
    data = []
    for i in range(300):
        idx = sorted(rng.sample(range(6), 4) + rng.sample(range(10, 400), 3)) if sparse and i % 9 else []
        data.append((i, rng.choice([0, 1, 2, None]), i % 2, [float(rng.randint(0, 3)) for _ in range(3)], idx, [float(rng.randint(1, 3)) for _ in idx]))
    rows = spark.createDataFrame(data, "id long, fold int, label int, vec array<double>, idx array<long>, val array<double>")
    rows = rows if sparse else rows.drop("idx", "val")
    found = {}
    for r in neighbours.nearest(rows, rows, 7, "fold", block_rows=64, pivots=5).collect():
        found.setdefault(r.test_id, []).append((r["rank"], r.dist2, r.train_id))

    def dist2(a, b):
        x, y = dict(zip(a[4], a[5])), dict(zip(b[4], b[5]))
        return sum((p - q) ** 2 for p, q in zip(a[3], b[3])) + sum((x.get(s, 0) - y.get(s, 0)) ** 2 for s in x.keys() | y.keys())

    for a in data:
        best = sorted((dist2(a, b), b[0]) for b in data if a[1] is None or a[1] != b[1])[:7]
        assert [(d, i) for _, d, i in sorted(found[a[0]])] == [(pytest.approx(d), i) for d, i in best]


def test_mails_are_parsed_in_pieces(spark):
    n = 2 * mailbox.PIECE + 3
    raw = spark.range(n, numPartitions=1).select(
        F.lit("p").alias("path"), F.col("id").alias("msg_no"),
        F.concat(F.lit("Subject: s"), F.col("id").cast("string"), F.lit("\nContent-Type: text/"), F.when(F.col("id") % 2 == 0, "plain").otherwise("html"), F.lit("\n\nb"), F.col("id").cast("string")).alias("raw"),
    )
    got = {r.msg_no: (r.subject, r.body, r.error) for r in mailbox.parse_mails(raw).collect()}
    assert got == {i: (f"s{i}", f"b{i}", None) if i % 2 == 0 else (None, None, "no plain text") for i in range(n)}


def test_terms_do_not_carry_their_text(spark, monkeypatch):
    """an exploded term has the value of its message, found below the explode, and not the text to find it in."""
    seen = []
    monkeypatch.setattr(train_eval.bayes, "cross_validate_with_numbers", lambda features, *_: seen.append(features) or features)
    texts = ["one two", "א ב", "", None, "two three"]
    folded = spark.createDataFrame([(i, i % 2, i % 2, t) for i, t in enumerate(texts)], "msg_id long, fold int, label int, text string")
    train_eval._full_bayes(folded, [0, 1], "latin", (1,), ("word",), None)
    rows = sorted((r.msg_id, r.term, r.value) for r in seen[0].collect())
    assert rows == [(0, "word:one", 1.0), (0, "word:two", 1.0), (1, "word:א", 0.0), (1, "word:ב", 0.0), (4, "word:three", 1.0), (4, "word:two", 1.0)]
    plan = seen[0]._jdf.queryExecution().optimizedPlan()
    above = plan.toString().split("Generate ")[0]
    assert "text#" not in above and "Filter (size(" not in plan.toString()


def test_vectors_of_all_folds_are_those_of_each(spark):
    """Terms, numbers and slots are made once for all folds and equal what every fold would make by itself."""
    rng = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "7", "א"]
    data = [(i if i % 11 else None, i % 3, i % 2, " ".join(rng.choice(words[: 5 + 4 * (i % 2)]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    data += [(3, 1, 0, "aa gg gg"), (3, 2, 1, "ff ff"), (77, None, 1, None), (78, None, 1, "aa bb")]
    folded = spark.createDataFrame(data, "msg_id long, fold int, label int, text string")
    made = features.FoldVectors(folded, [0, 1, 2], [1, 2], ["word"], "latin")
    for fold in (0, 1, 2):
        rows = made.of_fold(fold)
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        plain = features.Vectoriser([1, 2], ["word"], "latin").fit(train, classwords.class_words(train, script="latin"))
        for own, part in ((rows.where(F.col("fold") != fold), train), (rows.where(F.col("fold") == fold), test)):
            got, want = ([(r.msg_id, r.label, sorted(r.terms), list(r.scalars)) for r in df.collect()] for df in (own, plain.transform(part)))
            assert sorted(got, key=str) == sorted(want, key=str)
        seen, want = ([sorted(float(x) for x in r.features.values) for r in df.collect()] for df in (rows.where(F.col("fold") != fold), plain.transform(train)))
        assert sorted(seen) == sorted(want)
    slots = {}
    for r in made.of_fold(0).collect():
        width = made.blocks[0][1]
        assert r.features.size == width + len(features.SCALARS)
        slots.setdefault(tuple(sorted(r.terms)), set()).add(tuple(i for i in r.features.toArray()[:width].nonzero()[0]))
    assert all(len(s) == 1 for s in slots.values()) and len({next(iter(s)) for s in slots.values()}) == len(slots)


def test_substrings_are_looked_up_by_words(spark, monkeypatch):
    """a message asks for its words, pairs and triples, not for every prefix at every letter; and exactly the
    terms that it holds are found, whatever stands between words and however long they are."""
    rng = random.Random(11)
    bits = ["ab", "a", "b", "ba", "abc", "\U0001f600a", "é", "c" * 64, "c" * 65, "dc" * 70, "e" * 300]
    gaps = [" ", " ", " ", "  ", "\n", "\t", " \n", "\u00a0"]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(1, 9))) for _ in range(50)] + ["", None, " ab ", "x ab b"]
    data = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, texts[5])]
    df = spark.createDataFrame(data, "msg_id long, text string")
    terms = sorted({" ".join(rng.choice(bits[:-1]) for _ in range(rng.randint(1, 3))) for _ in range(120)})
    vocab = spark.createDataFrame([(k, t, 1, i) for i, t in enumerate(terms) for k in ("word", "other")[: 1 + i % 2]], "kind string, term string, n long, folds long")
    asked, join = [], ngrams.hot_join
    monkeypatch.setattr(ngrams, "hot_join", lambda left, *a, **kw: asked.append(left) or join(left, *a, **kw))
    got = sorted((r.msg_id or -1, r.kind, r.term, r.folds) for r in ngrams.match_substrings(df, vocab).collect())
    nulls = {r[0] or -1 for r in got}
    want = {(i or -1, k, t, n) for i, text in data for n, t in enumerate(terms) for k in ("word", "other")[: 1 + n % 2] if t in (text or "")}
    long = [t for t in terms if max(map(len, t.split(" "))) > ngrams.KEY]
    assert long and -1 in nulls
    assert got == sorted(w for w in want if w[0] != -1 or w[2] not in long)  # verified by id, a null one equals none
    asked.clear()
    plain = spark.createDataFrame([(1, "alpha bravo charlie delta echo")], "msg_id long, text string")
    ngrams.match_substrings(plain, vocab)
    assert asked[0].count() <= 3 * 5


def test_lines_without_anything_to_mask_stay_out_of_the_word_loop(frame):
    """Masks by line, counts and markers equal the forms over the whole text."""
    bits = ["see http://a.b/c", "x\thttps://y www.z", "a@b.co c@d.com", "*1234", "052-1234567)", "@972521234567", "LINK5ENDVAR", "xLINK7ENDVARy EMOJI#ENDVAR",
            "LINKLINK3ENDVAR", "ENTERNEWLINEENDVAR", " ENTERNEWLINEENDVAR ENTERNEWLINEENDVAR  a", "PHONENUMBER1ENDVAR", "é\U0001f600LINK9ENDVAR", "", "  ", "plain words # here"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", "\n\n", "\r\n", " \n "]) for _ in range(rng.randint(1, 9))) for _ in range(150)] + TEXTS
    df = frame(list(enumerate(texts)), "msg_id int, text string")
    t = F.col("text")
    strip = lambda c: F.btrim(c, F.lit(P.SPACES))
    whole = strip(masks.mask_emoji(masks.mask_emails(masks.mask_phones(masks.mask_links(strip(masks.mask_breaks(t))))), P.SYMBOL_GLYPHS))
    masked = censor.censor(df, glyphs=P.SYMBOL_GLYPHS).collect()
    assert [r.text for r in masked] == [r[0] for r in df.select(whole).collect()]
    kinds = f"({P.LINK}|{P.EMOJI}|{P.PHONE})"
    short = F.regexp_replace(t, f"{P.CHAR}*{kinds}{P.CHAR}*{P.END}{P.CHAR}*", "$1")
    places = F.filter(F.transform(words(t), lambda w, i: F.when(w.rlike("^LINK[0-9]+ENDVAR"), i / F.size(words(t)))), lambda p: p.isNotNull())
    pairs = [
        (ngrams.normalise_markers(t), F.array_join(words(short), " ")),
        (style.without_markers(t), F.regexp_replace(t, f"{P.CHAR}*{P.END}{P.CHAR}*", " ")),
        (style._marker(t, P.EMOJI, "."), F.regexp_count(t, F.lit(f"(?<!{P.CHAR})EMOJI.ENDVAR"))),
        (style._marker(t, P.LINK, "[0-9]+"), F.regexp_count(t, F.lit(f"(?<!{P.CHAR})LINK[0-9]+ENDVAR"))),
        (style.link_lengths(t), F.regexp_extract_all(t, F.lit(f"(?<!{P.CHAR})LINK([0-9]+)ENDVAR"), 1).cast("array<bigint>")),
        (style.link_places(t), places),
    ]
    for fast, slow in pairs:
        assert [r for r in df.select("text", fast.alias("a"), slow.alias("b")).collect() if r.a != r.b] == []
    plan = df.select(style.link_places(t).alias("p")).select(style._mean(F.col("p")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # words are looked for once, not once per mention
    split = censor.censor(df, glyphs=P.SYMBOL_GLYPHS)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in split


def test_small_trees_are_walked_inside_tasks(frame, monkeypatch):
    """without joins, whatever the batches; larger and odd trees go through the joins, with the same rows."""
    rng = random.Random(4)
    data = []
    for msg in range(120):
        n = rng.randint(1, 40)
        for sent in (0, 1)[: 1 + msg % 2]:
            heads = [rng.choice([0, 0, *range(1, n + 3)]) if rng.random() < 0.3 else rng.randint(0, i) for i in range(n)]
            data += [(msg, sent, i + 1, h, "r%d" % rng.randint(0, 3)) for i, h in enumerate(heads)]
    plain = frame(data, "msg_id long, sent_no int, tok_no int, head int, rel string")
    seen, joins = [], trees._by_joins
    monkeypatch.setattr(trees, "_by_joins", lambda t, keys: seen.append(t.count()) or joins(t, keys))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(joins(plain, trees.TREE))
    assert len({r[0] for r in want}) > 50 and max(r[5] for r in want) > 3
    assert rows(trees.reachable_nodes(plain)) == want and seen == []
    monkeypatch.setattr(trees, "WHOLE", 20)
    assert rows(trees.reachable_nodes(plain)) == want and 0 < seen[0] < len(data)
    odd = [(200, 0, 1, 0, "a"), (200, 0, 1, 0, "a"), (200, 0, 2, 1, "b"), (200, 0, 3, 2, None), (201, 0, None, 1, "c"), (201, 0, 1, 0, "d"), (201, 0, 2, None, "d"),
           (None, 0, 1, 0, "e"), (None, 0, 2, 1, "e"), (202, None, 1, 0, "f"), (203, 0, 2, 2, "g"), (204, 0, 1, 0, None)]
    strange = frame([*data, *odd], "msg_id long, sent_no int, tok_no int, head int, rel string")
    assert rows(trees.reachable_nodes(strange)) == rows(joins(strange, trees.TREE))
