import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwell.operators import boosting, classwords, dedup, neighbours, ngrams, sampling, skew, tags, trees
from siftwell.sources import tagged


def test_dedup_is_idempotent_and_counts(frame):
    rows = [(3, "a"), (1, "a"), (2, "b")]
    df = frame(rows, "msg_id bigint, text string")
    once = dedup.dedup(df, ["text"])
    assert {(r.text, r.msg_id, r.n_copies) for r in once.collect()} == {("a", 1, 2), ("b", 2, 1)}
    assert dedup.dedup(once.drop("n_copies"), ["text"]).count() == 2
    assert tuple(dedup.dedup_counts(df, ["text"]).first()) == (3, 2)


def test_conflict_report(frame):
    df = frame([(1, "s", 0, "a"), (2, "s", 1, "a"), (3, "s", 1, "b")], "msg_id bigint, dataset string, label int, text string")
    assert [(r.text, r.n_non_spam, r.n_spam) for r in dedup.class_conflicts(df).collect()] == [("a", 1, 1)]


def test_prune_and_union(frame):
    schema = "msg_id bigint, dataset string, label int, text string"
    df = frame([(1, "x", 0, "a"), (2, "x", 1, "b"), (3, "y", 0, "a")], schema)
    assert {r.msg_id for r in dedup.prune_datasets(df).collect()} == {1, 2}
    both = dedup.union_datasets(df.where("dataset = 'x'"), df.where("dataset = 'y'"))
    assert {(r.dataset, r.label, r.text, r.msg_id, r.n_copies) for r in both.collect()} == {("both", 0, "a", 1, 2), ("both", 1, "b", 2, 1)}


def test_caps_and_splits(spark):
    df = spark.range(2000).select(
        F.col("id").alias("msg_id"), F.lit("d").alias("dataset"), (F.col("id") % 3 == 0).cast("int").alias("label")
    )
    capped = sampling.cap_per_class(df, {1: 7, 0: None})
    assert sorted(r.msg_id for r in capped.where("label = 1").collect()) == list(range(0, 21, 3))
    assert capped.where("label = 0").count() == df.where("label = 0").count()
    split = sampling.stratified_split(df, 0.25, hex_digits=1).groupBy("label").agg(F.sum("is_test"), F.count("*")).collect()
    assert {r[0]: r[1] for r in split} == {r[0]: int(r[2] * 0.25 + 0.5) for r in split}
    folds = sampling.add_folds(df, 5)
    assert folds.count() == 2000 and {r.fold for r in folds.select("fold").distinct().collect()} == set(range(5))
    assert {r.fold for r in sampling.add_folds(df, 1).select("fold").distinct().collect()} == {-1, 0}


def test_shuffle_does_not_depend_on_layout(spark):
    one = [r.msg_id for r in sampling.shuffle_rows(spark.range(50).withColumnRenamed("id", "msg_id")).collect()]
    two = spark.range(50).withColumnRenamed("id", "msg_id").repartition(7)
    assert one == [r.msg_id for r in sampling.shuffle_rows(two).collect()] and one != sorted(one)


def test_hot_join_equals_plain_join(spark):
    left = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 2000).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    for how in ("inner", "left", "left_semi"):
        got = skew.hot_join(left, right, ["k"], "n", ["id"], how)
        want = left.join(right, ["k"], how)
        assert got.select("id", "k").exceptAll(want.select("id", "k")).isEmpty() and got.count() == want.count()


def test_first_n_of_a_hot_group(spark):
    """One class with 200,000 of 200,500 rows and n = 100,000: exact, and no task sorts more than `small` rows of it."""
    rows = spark.range(200500).select(
        F.when(F.col("id") < 200000, 0).otherwise(1).alias("g"), (F.col("id") * 7919 % 200503 - 90000).alias("v"), F.concat(F.lit("w"), F.col("id")).alias("word")
    )
    found = skew.first_n_per_group(rows, ["g"], skew.sortable(F.col("v")), 100000)
    values = sorted(i * 7919 % 200503 - 90000 for i in range(200000))
    got = found.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("v")).orderBy("g").collect()
    assert [(r.g, r.n) for r in got] == [(0, 100000), (1, 500)] and got[0].v == values[99999]
    # many equal counts, told apart by the word, with buckets of ten rows at most
    ties = rows.withColumn("v", F.col("v") % 3)
    key = F.concat(skew.sortable(-F.col("v")), "word")
    last = skew.last_of_first_n(ties, ["g"], key, 100000, small=10).orderBy("g").collect()
    want = sorted((f"{2**63 - int(r.v):020d}" + r.word for r in ties.where("g = 0").collect()))
    assert last[0]._last == want[99999]
    assert skew.first_n_per_group(rows.limit(0), ["g"], key, 3).count() == 0


def test_lookup(spark):
    left = spark.range(1000).withColumn("g", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7))
    right = spark.range(7).select(F.col("id").alias("g"), (F.col("id") * 10).alias("v"))
    found = {(r.id, r.g, r.v) for r in skew.lookup(left, right, ["g"]).collect()}
    assert found == {(i, 0 if i < 400 else i % 7, 0 if i < 400 else i % 7 * 10) for i in range(1000)}


def test_top_n_and_dense_index(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("t"), "id")
    top = skew.first_n_per_group(df, ["g"], skew.sortable(-F.col("id")), 3).collect()
    assert {(r.g, r.id) for r in top} == {(0, 498), (0, 496), (0, 494), (1, 499), (1, 497), (1, 495)}
    idx = [r.idx for r in skew.dense_index(df, ["t"]).collect()]
    assert sorted(idx) == list(range(500))


def test_word_and_letter_ngrams(frame):
    df = frame([(1, "a LINK25ENDVAR  EMAILENDVAR b"), (2, "")], "msg_id bigint, text string")
    words = [(r.n, r.term) for r in ngrams.explode_ngrams(df, kinds=["word"]).collect()]
    assert Counter(words) == Counter(
        [(1, "a"), (1, "LINK"), (1, "EMAILENDVAR"), (1, "b"), (2, "a LINK"), (2, "LINK EMAILENDVAR"), (2, "EMAILENDVAR b"),
         (3, "a LINK EMAILENDVAR"), (3, "LINK EMAILENDVAR b")]
    )
    letters = ngrams.explode_ngrams(frame([(1, "a\n😀b")], "msg_id bigint, text string"), kinds=["letter"]).collect()
    assert Counter(r.term for r in letters) == Counter(["a", "\n", "😀", "b", "a\n", "\n😀", "😀b", "a\n😀", "\n😀b"])


def test_vocabulary_cuts(frame):
    df = frame([(1, "a a a b b c")], "msg_id bigint, text string")
    grams = ngrams.explode_ngrams(df, kinds=["word"], sizes=[1])
    assert {r.term for r in ngrams.fit_vocabulary(grams, min_count=2).collect()} == {"a", "b"}
    assert {(r.term, r.idx) for r in ngrams.fit_vocabulary(grams, top=1).collect()} == {("a", 0)}


def test_substring_match_equals_brute_force(frame):
    rng = random.Random(7)
    bits = ["ab", "a", "b", "abc", "c" * 70, "bca", "d" * 140]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(bits, k=rng.randint(1, 9)))) for i in range(60)]
    df = frame(texts, "msg_id bigint, text string")
    train = df.where("msg_id < 30")
    vocab = ngrams.fit_vocabulary(ngrams.explode_ngrams(train, kinds=["word"])).persist()
    terms = [r.term for r in vocab.collect()]
    assert max(map(len, terms)) > 3 * ngrams.KEY
    got = {(r.msg_id, r.term) for r in ngrams.match_substrings(df, vocab).collect()}
    assert got == {(i, t) for i, text in texts for t in terms if t in text}
    grams = ngrams.explode_ngrams(df, kinds=["word"], distinct=True)
    single = {(i, t.replace("\n", " ").replace("  ", " ")) for i, t in texts}
    tokens = {(r.msg_id, r.term) for r in ngrams.match_terms(grams, vocab).collect()}
    assert {(i, t) for i, t in tokens if t in dict(texts)[i]} <= got and single


def test_class_words(frame):
    rows = [(0, "שלום לכם " * 5 + "א " * 9), (1, "מבצע " * 6 + "לכם " * 5), (1, "מבצע")]
    df = frame([(i, *r) for i, r in enumerate(rows)], "msg_id bigint, label int, text string")
    bag = classwords.class_words(df)
    assert {(r.label, r.word, r.n) for r in bag.collect()} == {(0, "שלום", 5), (1, "מבצע", 7)}
    assert [(r.label, r.word) for r in classwords.class_words(df, top=1).orderBy("label").collect()] == [(0, "שלום"), (1, "מבצע")]
    hits = {r.msg_id: (r.non_spam_words, r.spam_words) for r in classwords.class_word_hits(df, bag).collect()}
    assert hits == {0: (5, 0), 1: (0, 6), 2: (0, 1)}


def test_tag_ngrams_do_not_depend_on_blocks(frame, monkeypatch):
    rng = random.Random(3)
    rows = [(m, s, t, rng.choice("NVA"), 0, "r") for m in range(3) for s in range(2) for t in range(1, 23)]
    df = frame(rows, "msg_id bigint, sent_no int, tok_no int, pos string, head int, rel string")
    whole = sorted(map(tuple, tags.tag_ngrams_of_tokens(df).collect()))
    monkeypatch.setattr(tags, "BLOCK", 4)
    assert sorted(map(tuple, tags.tag_ngrams_of_tokens(df).collect())) == whole
    strings = defaultdict(list)
    for m, s, _, p, *_ in rows:
        strings[m, s].append(p)
    sents = frame([(m, s, " ".join(v)) for (m, s), v in strings.items()], "msg_id bigint, sent_no int, tags string")
    assert sorted(map(tuple, tags.tag_ngrams(sents).collect())) == whole


def test_tree_fixture(frame):
    df = frame([(1, "a~NN~2~subj b~VB~0~ROOT c~NN~2~obj . d~VB~0~ROOT")], "msg_id bigint, text string")
    nodes = trees.reachable_nodes(tagged.parse_tagged(df, unit="tree")).persist()
    assert tuple(trees.tree_shape(nodes).first()) == (1, 2, 2, 3)
    paths = trees.path_ngrams(nodes)
    assert {r.term: r.n for r in trees.path_ngram_counts(paths).collect()} == {
        "ROOT": 2, "subj": 1, "obj": 1, "ROOT subj": 1, "ROOT obj": 1
    }
    assert {r.term: r.n for r in trees.path_vocabulary(paths).collect()}["ROOT"] == 2


def test_trees_equal_a_walk(frame):
    rng = random.Random(11)
    rows = []
    for m in range(40):
        n = rng.randint(1, 30)
        rows += [(m, 0, i, rng.randint(0, n + 1) if rng.random() < 0.9 else 0, rng.choice("xyz")) for i in range(1, n + 1)]
    df = frame(rows, "msg_id bigint, sent_no int, tok_no int, head int, rel string")
    want = {}
    for m in range(40):
        mine = {t: h for a, _, t, h, _ in rows if a == m}
        roots = [t for t, h in mine.items() if h == 0]
        level = {max(roots): 0} if roots else {}
        queue = list(level)
        while queue:
            top = queue.pop()
            for t, h in mine.items():
                if h == top:
                    level[t] = level[top] + 1
                    queue.append(t)
        want.update({(m, t): v for t, v in level.items()})
    got = {(r.msg_id, r.tok_no): r.level for r in trees.reachable_nodes(df).collect()}
    assert got == want


def nearest_by_hand(points, tests, trains, n):
    far = {i: sorted((sum((a - b) ** 2 for a, b in zip(points[i], points[j], strict=True)), j) for j in trains(i)) for i in tests}
    return {i: {k + 1: d[k][1] for k in range(min(n, len(d)))} for i, d in far.items()}


def nearest_found(found):
    got = defaultdict(dict)
    for r in found.collect():
        got[r.test_id][r.rank] = r.train_id
    return got


def as_sparse(df, first):
    """Places from first on as slots."""
    keep = F.filter(F.transform("vec", lambda v, i: F.struct(i.cast("bigint").alias("i"), v.alias("v"))), lambda s: (s["v"] != 0) & (s["i"] >= first))
    dense = [F.slice("vec", 1, first).alias("vec")] if first else []
    return df.withColumn("s", keep).select(*(c for c in df.columns if c != "vec"), *dense, F.col("s.i").alias("idx"), F.col("s.v").alias("val"))


@pytest.mark.parametrize("dense_places", [6, 2, 0])  # all dense, both, all sparse
def test_neighbours_equal_brute_force(frame, dense_places):
    rng = random.Random(5)
    points = [[float(rng.randint(0, 3)) for _ in range(6)] for _ in range(90)]
    df = frame([(i, i % 2, i % 3, p) for i, p in enumerate(points)], "id bigint, label int, fold int, vec array<double>")
    df = as_sparse(df, dense_places) if dense_places < 6 else df
    for n, pivots in ((7, 1), (7, 16), (40, 8), (100, 8)):  # one k is larger than the table
        found = neighbours.nearest(df.where("id < 60"), df.where("id >= 60").drop("label"), n, block_rows=16, pivots=pivots)
        assert nearest_found(found) == nearest_by_hand(points, range(60, 90), lambda i: range(60), n)
    found = neighbours.nearest(df, df, apart="fold", block_rows=16)
    assert nearest_found(found) == nearest_by_hand(points, range(90), lambda i: [j for j in range(90) if j % 3 != i % 3], 21)
    assert neighbours.nearest(df.limit(0), df, 3).count() == neighbours.nearest(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("first_slot", [8, 1])
def test_far_rows_are_not_looked_at(frame, first_slot):
    """Forty clusters, one with a third of all rows: exact, and most pairs are never compared."""
    rng = random.Random(7)
    centres = [[rng.random() * 100 for _ in range(8)] for _ in range(40)]
    points = [[max(0.0, x + rng.gauss(0, 0.5)) for x in centres[0 if i % 3 == 0 else rng.randrange(40)]] for i in range(900)]
    df = frame([(i, i % 2, p) for i, p in enumerate(points)], "id bigint, label int, vec array<double>")
    df = as_sparse(df, first_slot) if first_slot < 8 else df
    train, test = df.where("id >= 300"), df.where("id < 300")
    found = neighbours.nearest(train, test, 5, block_rows=64)
    assert nearest_found(found) == nearest_by_hand(points, range(300), lambda i: range(300, 900), 5)
    assert found.count() == 1500  # k rows per test row leave the search
    share = neighbours.share_looked_at(found, 600).first()
    assert (share.pairs, share.looked) == (180000, share.share * 180000) and share.share < 0.3


def test_vote_ties_go_to_the_lower_label(frame):
    df = frame([(1, 1), (1, 0), (2, 1)], "test_id bigint, label int")
    assert {r.test_id: r.predicted for r in neighbours.vote(df).collect()} == {1: 0, 2: 1}


def test_default_k():
    assert (neighbours.default_k(400), neighbours.default_k(399)) == (60, 57)


def test_boosting_by_hand(frame):
    schema = "msg_id bigint, label int, terms array<string>"
    rows = frame([(0, 1, ["x"]), (1, 1, ["x"]), (2, 0, ["x"]), (3, 0, ["y"])], schema)
    errors = {r.term: (r.present, r.error) for r in boosting.stump_errors(rows.withColumn("w", F.lit(1.0))).collect()}
    assert errors == {"x": (1, 0.25), "y": (0, 0.25)}
    stumps = boosting.fit(rows, rounds=3)
    # id 2 weighs three times after round 1, and then no stump is better than chance
    assert [(s.term, s.present, round(s.alpha, 6)) for s in stumps] == [("x", 1, round(math.log(3), 6))]
    assert {r.msg_id: r.predicted for r in boosting.predict(stumps, rows).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
    # a term that tells the classes apart ends the search
    told = frame([(0, 1, ["x"]), (1, 1, ["x"]), (2, 0, ["x", "z"]), (3, 0, ["y", "z"])], schema)
    assert [(s.term, s.present) for s in boosting.fit(told, rounds=3)] == [("z", 0)]


def test_boosting_equals_a_loop(frame):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 1), rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(40)]
    weights, want = [1.0] * 40, []
    for _ in range(4):
        best = []
        for t in "abcdefgh":
            for present in (0, 1):
                wrong = sum(w for w, (_, y, ts) in zip(weights, data, strict=True) if (present if t in ts else 1 - present) != y)
                best.append((round(wrong / sum(weights), 9), t, present))
        error, t, present = min(best)
        alpha = math.log((1 - error) / error)
        want.append((t, present, round(alpha, 6)))
        weights = [
            w * math.exp(alpha) if (present if t in ts else 1 - present) != y else w for w, (_, y, ts) in zip(weights, data, strict=True)
        ]
    stumps = boosting.fit(frame(data, "msg_id bigint, label int, terms array<string>"), rounds=4)
    assert [(s.term, s.present, round(s.alpha, 6)) for s in stumps] == want


NUMBERED = "msg_id bigint, label int, terms array<string>, numbers array<struct<term: string, value: double>>"


def test_a_stump_between_two_octiles(frame):
    """One threshold of 999 tells the classes apart; equal values and rows without the number are no threshold."""
    data = [(i, int(i > 437), ["t"], [("n", float(i)), ("same", 5.0)] + [("rare", 2.0)] * (i == 3)) for i in range(1000)]
    stump, *others = boosting.fit(frame(data, NUMBERED), rounds=5)
    assert (stump.term, stump.cut, stump.present, others) == ("n", 437.5, 1, [])
    cuts = boosting.cut_errors(frame(data, NUMBERED).withColumn("w", F.lit(1.0))).collect()
    assert sorted(r.cut for r in cuts if r.term == "n") == [i + 0.5 for i in range(999)]
    assert [(r.term, r.cut) for r in cuts if r.term != "n"] == [("rare", 1.0)]


def test_boosting_with_numbers_equals_a_loop(frame):
    rng = random.Random(6)
    data = []
    for i in range(150):
        numbers = [("a", rng.randint(0, 400) / 7), ("b", float(rng.randint(0, 3)))] + [("c", float(rng.randint(1, 4)))] * rng.randint(0, 1)
        data.append((i, int(numbers[0][1] + 9 * numbers[1][1] + rng.random() * 25 > 45), rng.sample("xyz", rng.randint(0, 2)), numbers))
    of = [dict(numbers) for *_, numbers in data]
    questions = [(t, None, [t in terms for _, _, terms, _ in data]) for t in "xyz"]
    for name in "abc":
        values = sorted({v.get(name, 0.0) for v in of})
        questions += [(name, (p + q) / 2, [v.get(name, 0.0) > (p + q) / 2 for v in of]) for p, q in zip(values, values[1:])]
    weights, want = [1.0] * len(data), []
    for _ in range(10):
        best = []
        for term, cut, yes in questions:
            wrong = sum(w for w, (_, y, *_), a in zip(weights, data, yes, strict=True) if int(a) != y) / sum(weights)
            best.append((round(min(wrong, 1 - wrong), 9), term, -1.0 if cut is None else cut, int(wrong <= 0.5), yes))
        error, term, cut, present, yes = min(best, key=lambda x: x[:3])
        alpha = math.log((1 - error) / error)
        want.append((term, cut, present, round(alpha, 5)))
        weights = [w * math.exp(alpha) if (present if a else 1 - present) != y else w for w, (_, y, *_), a in zip(weights, data, yes, strict=True)]
    stumps = boosting.fit(frame(data, NUMBERED), rounds=10)
    assert [(s.term, -1.0 if s.cut is None else s.cut, s.present, round(s.alpha, 5)) for s in stumps] == want
    margin = {r.msg_id: r.margin for r in boosting.predict(stumps, frame(data, NUMBERED)).collect()}
    for i, row in enumerate(data):
        said = [s.present if (s.term in row[2] if s.cut is None else of[i].get(s.term, 0.0) > s.cut) else 1 - s.present for s in stumps]
        assert round(margin[i], 6) == round(sum(s.alpha if x else -s.alpha for s, x in zip(stumps, said, strict=True)), 6)
