"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import near_dup, quality
from siftwell.llm.decontaminate import contained_items
from siftwell.llm.substring_dedup import remove_repeats
from siftwell.session import cut_lineage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def some(rng, n, kinds=50):
    return [f"w{rng.randint(0, kinds)}" for _ in range(n)]


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.random()}"
    return w


def corpus(seed=2):
    rng = random.Random(seed)
    base = some(rng, 400)
    rows = []
    for _ in range(40):
        w = edited(rng, base[rng.randint(0, 200) : rng.randint(230, 400)], rng.randint(0, 5))
        rows.append(" ".join(some(rng, rng.randint(0, 60)) + w + some(rng, rng.randint(0, 60))))
    rows += ["a " * k for k in (0, 1, 34, 35, 36, 70, 500)] + ["a b " * k for k in (10, 17, 18, 30, 300)] + ["a b c d e " * 20]
    rows += ["q " + "a " * 34 + "r", "q " + "a " * 35 + "r", None, "", " \n ", " ".join(some(rng, 34)), rows[0], rows[0], rows[3]]
    rows += [" ".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(60)]
    return rows + [" ".join(some(rng, 3000) + base[100:135] + some(rng, 3000)), " ".join(base[100:134]) + " z"]


def test_repeats_brute_force(spark):
    texts, k = corpus(), 35
    counts = Counter(tuple(words(t)[s : s + k]) for t in texts for s in range(len(words(t)) - k + 1))
    df = spark.createDataFrame([(i, t, 1, "t") for i, t in enumerate(texts)], "doc_id long, text string, copies int, _text string")
    found = {r.doc_id: r for r in remove_repeats(df.repartition(4)).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if counts[tuple(w[s : s + k])] > 1:
                gone[s : s + k] = [True] * k
        assert (found[i].n_words, found[i].n_removed) == (len(w), sum(gone))
        assert found[i].kept.encode() == b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
    assert remove_repeats(df.limit(0)).count() == 0


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)].append(doc)
    return [(doc, len(sets[i]), min(smallest[find(i)])) for i, (doc, _) in enumerate(rows)]


def chains(seed=4):
    """Groups of near copies with 0 to 12 edits, so that links run through some members and miss others; small sets; copies."""
    rng = random.Random(seed)
    texts = []
    for group in range(6):
        base = some(rng, rng.choice([30, 80, 150]), 1000)
        texts += [" ".join(edited(rng, base, rng.randint(0, 12))) for _ in range(25)]
        step = list(base)
        for at in range(0, 24, 2):  # each differs from the one before by a word
            step[at] = f"c{group}.{at}"
            texts.append(" ".join(step))
    texts += ["a", "A", "a b", "a b c d e f g h", "A b c d e f g h i", "a b c d e f g", "", None, "  "] + ["same words in all of these"] * 30
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_brute_force(spark):
    rows = chains()
    df = spark.createDataFrame([(*row, 1, "x") for row in rows], "doc_id long, text string, label int, bands string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.components(df).collect())
    assert found == sorted(brute_components(rows))
    assert near_dup.components(df.limit(0)).count() == 0


def test_near_duplicate_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (9, text), (9, text), (3, text), (None, ""), (None, "other words that stand for themselves alone")]
    found = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == {(None, 3, False): 1, (9, 3, False): 2, (3, 3, True): 1, (None, None, True): 2}


def test_classes_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(2000, 2001), (2001, 2000), (5, 5)]
    found = {r.id: r.label for r in near_dup.merge(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[i] == 1000 for i in range(1000, 1400)) and found[2001] == 2000
    assert near_dup.merge(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("max_broadcast", [0, 10**6])
def test_contained_items_brute_force(spark, max_broadcast):
    rng = random.Random(7)
    items = [" ".join(some(rng, rng.randint(1, 60), 300)) for _ in range(40)] + ["", None, "two words", "a b c d e"]
    docs = []
    for _ in range(120):
        w = some(rng, rng.randint(0, 400), 300)
        for item in rng.sample(items[:40], 2):
            w[len(w) // 2 : len(w) // 2] = edited(rng, item.upper().split(), rng.choice([0, 0, 1, 2]))
        docs.append(" ".join(w))
    docs += ["Two  words", "two words more", None, "", docs[0], "a b c d e " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(list(enumerate(items)) + [(None, docs[0])], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.n_shingles, r.n_common) for r in contained_items(df, table, max_broadcast=max_broadcast).collect()}
    wanted = {}
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            a, b = shingles(doc), shingles(item)
            if b and 100 * len(a & b) >= 75 * len(b):
                wanted[i, j] = (len(b), len(a & b))
    assert found == wanted and len(wanted) > 100


def brute_bits(trusted, text):
    """Bits of a text under the interpolated modified Kneser-Ney model of trusted texts."""

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        d = [0.0]
        for i in (1, 2, 3):
            found = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else i / 2
            d.append(max(0.1, min(found, float(i))))
        return lambda c: d[min(c, 3)]

    three = Counter(("\x02\x02" + t)[i : i + 3] for t in trusted for i in range(len(t)))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)
    levels = [(three, discounts(three)), (two, discounts(two)), (one, discounts(one))]

    def p(gram, level):
        if level == 3:
            return 1 / (len(one) + 1)
        counts, d = levels[level]
        context = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        total, lower = sum(context.values()), p(gram[1:], level + 1)
        if not total:
            return lower
        n = counts.get(gram, 0)
        return (n - (d(n) if n else 0) + sum(d(c) for c in context.values()) * lower) / total

    return -sum(math.log2(p(("\x02\x02" + text)[i : i + 3], 0)) for i in range(len(text)))


def test_perplexity_brute_force(spark):
    rng = random.Random(6)

    def line(letters):
        found = []
        for _ in range(rng.randint(1, 30)):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
            found += [word] if found[-1:] != [word] else []  # no word repeats the one before it
        return " ".join(found)

    rows = [(i, line("abcde"), "x") for i in range(30)] + [(i, line("éßñ"), None) for i in range(30, 40)]
    rows += [(40, line("XYZ#"), "x"), (41, "", "x"), (42, None, "x"), (43, "abc", "unknown"), (44, "ab ab ab cd", "x"), (45, "abc " * 9000, "x"), (1, rows[1][1], "x")]
    trusted = [*range(20), *range(30, 36), 41]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, score string, bits double")
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    said = {44: "↺↺ab cd", 45: "↺" * 8999 + "abc "}
    texts = {lang: [t for i, t, g in rows if i in trusted and g == lang and t] for lang in ("x", None)}
    for max_broadcast in (0, 10**6):
        found = quality.score(df, ids, max_broadcast=max_broadcast).collect()
        assert len(found) == len(rows)
        for r in found:
            text = said.get(r.doc_id) or next(t for i, t, _ in rows if i == r.doc_id)
            if r.doc_id in (41, 42):
                assert r.perplexity is None and r.kept
            elif r.doc_id == 43:
                assert r.perplexity is None and r.threshold is None and r.kept
            else:
                wanted = 2 ** (brute_bits(texts[r.lang], text) / len(text))
                assert r.n_symbols == len(text) and abs(r.perplexity / wanted - 1) < 1e-6
        assert not next(r for r in found if r.doc_id == 40).kept
    nobody = quality.score(df, ids.limit(0)).collect()
    assert len(nobody) == len(rows) and all(r.kept for r in nobody)
    assert quality.score(df.limit(0), ids).count() == 0


def test_junk_is_rejected(spark):
    found = quality.op5_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = Counter((r.quality, r.kept) for r in found.join(labels, "doc_id").collect())
    assert judged[0, True] <= 0.05 * judged[0, False] and judged[1, False] <= 0.01 * judged[1, True]


def test_tiles_of_many_short_nodes():
    """Memory of a tile doesn't follow askers x members, whether all its pairs are open or none."""
    n = 9_000
    for least in (3, 4):
        shingles = [[1, 2, 3, 10 + i] if i % 1000 else [1, 2, 3, 4] for i in range(n)]
        numbers = {"asks": [int(i < 3_000) for i in range(n)], "id": range(n), "n": [4] * n, "rest": [least] * n, "label": range(n)}
        rows = pa.table({**{c: pa.array(x, pa.int64()) for c, x in numbers.items()}, "shingles": pa.array(shingles, pa.list_(pa.int64()))})
        tracemalloc.start()
        found = near_dup._tile_links(rows, 75)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(found) == [(a, b) for a in range(0, 3_000, 1000) for b in range(3_000, n, 1000) if least == 4] and peak < 150e6


def test_short_texts_of_one_template(spark):
    """50,000 texts whose last word alone differs: they share buckets, and nothing links."""
    df = spark.range(50_000).selectExpr("id AS doc_id", "concat('one two three four five six seven w', id) AS text")
    found = near_dup.components(df).agg(F.count("*").alias("n"), F.countDistinct("component_id").alias("classes"), F.min("kept").alias("all")).first()
    assert (found.n, found.classes, found["all"]) == (50_000, 50_000, True)


def test_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.op5_quality(spark, folder).withColumnRenamed("toxic", "found")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = Counter((r.toxic, r.found) for r in found.join(labels.where("quality = 1"), "doc_id").collect())
    assert judged[1, True] >= 0.25 * judged[1, False] and judged[0, True] <= 0.03 * judged[0, False]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder).select("doc_id").collect()
    assert not {r.doc_id for r in found.where("found").collect()} & {r.doc_id for r in kept}


def test_word_scores_brute_force(spark):
    """Every labelled document is scored by the counts of all others."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the cat", "a dog", "sat", "on", f"w{rng.randint(0, 9)}", "Fool!" if i % 3 == 0 else "it"]) for _ in range(rng.randint(3, 40))), "x") for i in range(30)]
    good, bad = {i for i in range(24) if i % 3}, {i for i in range(24) if not i % 3}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = lambda some: spark.createDataFrame([(i,) for i in sorted(some)], "doc_id long")
    found = {r.doc_id: r for r in quality.score(df, ids(good), toxic=ids(bad)).collect()}

    def pairs(text):
        w = ["", *(x.strip("!↺") for x in text.lower().split())]
        return list(zip(w, w[1:], strict=False))

    normal = {r.doc_id: r._text for r in df.select("doc_id", quality.normal_text(df.text).alias("_text")).collect()}
    counts = lambda some: Counter(p for i in some for p in pairs(normal[i]))
    discount = lambda c: max(0.1, n[1] / (n[1] + 2 * n[2])) if (n := Counter(c.values()))[1] + n[2] else 0.5
    n, m = counts(good), counts(bad)
    k, l = Counter(c for _, c in n), Counter(c for _, c in m)
    d2, d1, dt = discount(n), discount(k), discount(l)
    kinds, toxic_kinds = len(k), len(l)
    for i, text in normal.items():
        n, m = counts(good - {i}), counts(bad - {i})
        k, l = Counter(c for _, c in n), Counter(c for _, c in m)
        total, after = Counter(), Counter(b for b, _ in n)
        for (b, _), x in n.items():
            total[b] += x
        best, run, bits = -math.inf, 0.0, []
        for b, c in pairs(text):
            p = (max(k[c] - d1, 0) + d1 * kinds / (kinds + 1)) / len(n)
            p = (max(n[b, c] - d2, 0) + d2 * after[b] * p) / total[b] if total[b] else p
            bits.append(-math.log2(p))
            run = max(run, 0.0) + math.log2((max(l[c] - dt, 0) + dt * toxic_kinds * p) / len(m) / p)
            best = max(best, run)
        assert abs(found[i].worst - best + 2 * math.log2(len(bits))) < 1e-6 and abs(found[i].word_bits - sum(bits) / len(bits)) < 1e-6


def test_pipeline_stages(spark, documents):
    """Every stage on its own input, next to what its operator must decide; extra columns pass through."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    copy = docs.orderBy("doc_id").limit(3)
    docs = cut_lineage(docs.union(copy).union(spark.createDataFrame([(None, None, None, None, None), (99999, "", "en", "s", 0)], docs.schema)))
    extra = docs.selectExpr("*", "1 as _row", "'x' as spans", "2 as label", "'k' as _key")
    for name, stage in corpus_pipeline.STAGES:
        before, after = extra.collect(), cut_lineage(stage(spark, extra, folder))
        kept = after.collect()
        if name == "bpe":
            assert len(kept) == len(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in kept)
            break
        assert after.columns == extra.columns
        assert any(r.doc_id is None for r in kept) and any(r.doc_id == 99999 for r in kept)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
            wanted = {c for _, n, c in brute_components(rows) if n}
            assert sorted(r.doc_id for r in kept if shingles(r.text)) == sorted(wanted)
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            leaks = lambda t: any(i and 100 * len(shingles(t) & i) >= 75 * len(i) for i in items)
            assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in before if not leaks(r.text))
        if name == "secrets":
            assert len(kept) == len(before) and all(r.n_chars == len(r.text) for r in kept if r.text and "[secret]" in r.text)
        extra = after


def test_digest_of_ids(spark):
    from siftwell.llm.bpe import op4_bpe

    row = op4_bpe(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_are_written_before_they_are_decoded(spark):
    """Pipeline, bpe: no task holds an encoder and a decoder at once."""
    docs = spark.createDataFrame([(1, "en", "s", "one two <|endoftext|> é"), (2, "de", None, None), (None, "de", "s", "")], "doc_id long, lang string, source string, text string")
    out = corpus_pipeline.bpe_stage(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.collect()) and out.count() == 3
