import math
import random
import re

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from siftwell.operators import bayes, classwords, evaluate, features, models
from siftwell.operators.censor import censor
from siftwell.operators.ngrams import explode_ngrams
from siftwell.operators.sampling import add_folds
from siftwell.plans import inputs, train_eval
from siftwell.session import cut_lineage
from siftwell.sources.tagged import plain_from_tagged
from siftwell.streaming import clean_stream

FOLDER = "/root/testdata/sf0.001"


def predictions(frame, tn, fp, fn, tp):
    rows = [("m", 0, 0, 0)] * tn + [("m", 0, 0, 1)] * fp + [("m", 0, 1, 0)] * fn + [("m", 0, 1, 1)] * tp
    return frame([(i, *r) for i, r in enumerate(rows)], "msg_id bigint, model string, fold int, label int, predicted int")


def test_published_cost_ratio(frame):
    # 227 spam messages, 10 weighted errors and 33 others give 5.2791, 0.2219, 0.0226
    m = evaluate.confusion(predictions(frame, 500, 10, 33, 194))
    got = {r["lambda"]: round(r.tcr, 4) for r in evaluate.weighted_scores(m).collect()}
    assert got == {1: 5.2791, 99: 0.2219, 999: 0.0226}


def test_as_written_is_the_swapped_matrix(frame):
    a = evaluate.confusion(predictions(frame, 50, 4, 9, 20))
    b = evaluate.confusion(predictions(frame, 50, 9, 4, 20))
    assert evaluate.weighted_scores(a, convention="as_written").collect() == evaluate.weighted_scores(b).collect()
    row = evaluate.f1_scores(a, "as_written").first()
    assert (row.recall, row.precision) == (pytest.approx(50 / 54), pytest.approx(20 / 29))
    with pytest.raises(ValueError):
        evaluate.f1_scores(a, "paper").transform(evaluate.weighted_scores, convention="other")


def test_nothing_to_divide_by(frame):
    p = predictions(frame, 5, 0, 0, 3)
    scores = evaluate.fold_scores(p)
    assert all(r.tcr is None and r.wacc == 1.0 for r in scores.collect())
    assert evaluate.fold_summary(scores).first().tcr_mean is None
    assert evaluate.f1_scores(evaluate.confusion(predictions(frame, 5, 0, 3, 0))).first().f1 is None


def test_report_and_errors(frame):
    p = predictions(frame, 6, 2, 1, 3)
    rows = {r["class"]: r for r in evaluate.class_report(p).collect()}
    assert rows["0"].support == 8 and rows["1"].recall == pytest.approx(0.75)
    assert rows["weighted"].precision == pytest.approx((8 * 6 / 7 + 4 * 3 / 5) / 12)
    errors = evaluate.error_report(p).collect()
    assert [r.predicted for r in errors] == [0, 1, 1]


def test_baseline_and_margin(frame):
    df = frame([(0, "a"), (0, "a"), (0, "b"), (1, "a"), (1, "c")], "label int, text string")
    assert tuple(evaluate.baseline_accuracy(df).first()) == (2, 3, pytest.approx(2 / 3))
    row = evaluate.accuracy(predictions(frame, 3, 1, 0, 0), F.lit(0.5)).first()
    assert (row.accuracy, row.margin) == (0.75, 0.25)


def test_bayes_equals_mllib(spark):
    rows = inputs.labelled(spark, FOLDER).withColumn("fold", F.col("msg_id") % 2 - 1)  # folds -1 and 0
    terms = explode_ngrams(rows, kinds=["word"], sizes=[1], keep=["msg_id", "fold", "label"], distinct=True)
    own = bayes.cross_validate(terms.withColumn("value", F.lit(1.0)), rows.select("msg_id", "fold", "label"))
    vectors = features.Vectoriser([1], ["word"], "latin", style=False).fit(rows.where("fold = -1"), None)
    fitted = NaiveBayes(smoothing=1.0).fit(vectors.transform(rows.where("fold = -1")))
    theirs = fitted.transform(vectors.transform(rows.where("fold = 0")))
    # MLlib also smooths the class shares; take them out on both sides
    counts = {r.label: r["count"] for r in rows.where("fold = -1").groupBy("label").count().collect()}
    prior = [math.log(counts[c] / sum(counts.values())) for c in (0, 1)]
    a = {r.msg_id: [round(r.score0 - prior[0], 6), round(r.score1 - prior[1], 6)] for r in own.collect()}
    b = {r.msg_id: [round(float(x), 6) for x in r.rawPrediction.toArray() - fitted.pi.toArray()] for r in theirs.collect()}
    assert a == b


def test_wide_vocabularies_are_an_error(spark):
    rows = inputs.labelled(spark, FOLDER)
    with pytest.raises(ValueError, match="max_width=64"):
        features.Vectoriser([1], ["word"], "latin", max_width=64, style=False).fit(rows, None)
    vectors = features.Vectoriser([1], ["word"], "latin", style=False).fit(rows, None)
    words = {w for r in rows.collect() for w in re.findall(r"[^ \t\n\x0b\f\r]+", r.text)}
    assert vectors.transform(rows).first().features.size >= 0.9 * len(words)


def test_no_text_is_in_two_folds(spark):
    rows = inputs.labelled(spark, FOLDER)
    doubled = rows.union(rows.withColumn("msg_id", F.col("msg_id") + 10**9))
    found = train_eval.bayes_predictions(doubled).join(doubled.select("msg_id", "text"), "msg_id")
    folds = found.groupBy("text").agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    assert folds.where("folds > 1 OR n > labels").isEmpty()


def separable(spark):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("meeting at noon "), F.col("id").cast("string")))
    text = F.coalesce(text, F.concat(F.lit("win money now!!! "), F.col("id").cast("string")))
    return spark.range(60).select(
        F.col("id").alias("msg_id"), F.lit("d").alias("dataset"), (F.col("id") % 2).cast("int").alias("label"), text.alias("text")
    )


def test_all_models_learn_a_separable_set(spark):
    out, times = train_eval.model_predictions(separable(spark), 3, folds=[0], script="latin", rounds=3, max_iter=20)
    hits = {r.model: r.hit for r in out.groupBy("model").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("hit")).collect()}
    assert hits == {name: 1.0 for name in models.MODEL_NAMES}
    assert {t[0] for t in times} == set(models.MODEL_NAMES) and all(math.isfinite(t[2]) for t in times)


def test_no_vocabulary_but_for_linear_models(spark, monkeypatch):
    def none(*args, **options):
        raise AssertionError("a vocabulary came to the driver")

    monkeypatch.setattr(features, "CountVectorizer", none)
    names = ["MultinomialNB", "KNeighbors", "AdaBoost"]
    out, times = train_eval.model_predictions(separable(spark), 3, names, folds=[0, 2], script="latin", sizes=[1], rounds=2)
    assert {(r.model, r.fold) for r in out.collect()} == {(n, f) for n in names for f in (0, 2)} == {t[:2] for t in times}
    assert out.where("label <> predicted").isEmpty()
    with pytest.raises(AssertionError):
        train_eval.model_predictions(separable(spark), 3, ["SVM"], folds=[0], script="latin", sizes=[1])


def test_model_set(spark):
    found = train_eval.model_set(separable(spark), script="latin", sizes=[1], rounds=3, max_iter=20).collect()
    assert {(r.model, r.n_test, r.n_right) for r in found} == {(name, 16, 16) for name in models.MODEL_NAMES}
    assert all(r.seconds > 0 for r in found)


def test_run_report(spark, frame):
    messages = frame([(0, "a"), (0, "b"), (1, "c"), (1, "d")], "label int, text string")
    rows = [(0, "m", 0, 0, 0), (1, "m", 0, 0, 1), (2, "m", 1, 1, 1), (3, "m", 1, 1, 1)]
    predictions = frame(rows, "msg_id bigint, model string, fold int, label int, predicted int")
    found = {(r.section, r["item"]): r["value"] for r in train_eval.run_report(messages, predictions).collect()}
    assert found["baseline", ""] == 0.5 and found["accuracy", "0"] == 0.5 and found["margin", "1"] == 0.5
    assert found["recall", "0"] == 0.5 and found["support", "1"] == 2 and found["error", "1 1"] == 1
    assert ("tcr_mean", "99") in found and found["folds_above_one", "1"] == 0


def test_grid(spark):
    rows = separable(spark).withColumn("dataset", F.when(F.col("msg_id") < 30, "sms").otherwise("email"))
    runs = [train_eval.Run(k=3, non_spam_cap=10), train_eval.Run(k=1, union=True), train_eval.Run(model=2, k=1)]
    out = train_eval.run_grid(rows, runs, script="latin", sizes=[1], max_iter=10).collect()
    assert {(r.run_id, r.dataset, r.n_messages) for r in out} == {
        (0, "sms", 25), (0, "email", 25), (1, "both", 60), (2, "sms", 30), (2, "email", 30)
    }


def test_tag_and_tree_features_decide(spark):
    # the words are the same in both classes, only tags and heads differ
    spam = (F.col("id") % 2 == 1).cast("int")
    text = F.when(spam == 1, "one~NN~0~r two~JJ~1~a").otherwise("one~NN~2~s two~VB~0~r")
    text = F.concat(text, F.lit(" n"), F.floor(F.col("id") / 2).cast("string"), F.lit("~CD~1~n"))
    rows = spark.range(40).select(F.col("id").alias("msg_id"), F.lit("d").alias("dataset"), spam.alias("label"), text.alias("text"))
    rejected = rows.limit(1).withColumn("msg_id", F.lit(99).cast("bigint")).withColumn("text", F.lit(" ul "))
    runs = [train_eval.Run(model=0, k=1, morphological=True, tags=True, trees=True)]
    out = train_eval.run_grid(rows.union(rejected), runs, script="latin", sizes=[1], rounds=3, max_iter=20).collect()
    assert {r.model for r in out} == set(models.MODEL_NAMES)
    assert all(r.n_messages == 40 and r.has_tags and r.has_trees for r in out)
    assert {r.model: r.f1_mean for r in out} == {m: 1.0 for m in models.MODEL_NAMES}


@pytest.mark.parametrize("k", [1, 3])
def test_one_pass_bayes_equals_a_model_per_fold(spark, k):
    """Terms, numbers, class words and annotations: the same verdicts as MLlib's model fitted on each fold's training rows."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "offer", "win", "שלום"]
    data = [(i, "d", i % 3 % 2, " ".join(f"{rng.choice(words)}~{rng.choice(['NN', 'VB'])}~{rng.choice('012')}~r" for _ in range(rng.randint(1, 9)))) for i in range(60)]
    tagged = spark.createDataFrame([*data, (99, "d", 1, "!!!~X~0~r")], "msg_id long, dataset string, label int, text string")
    tagged = cut_lineage(train_eval.once_per_class(tagged))
    noted = features.annotation_features(tagged)
    rows = cut_lineage(tagged.withColumn("text", plain_from_tagged(F.col("text"))))
    for annotations in (None, noted) if k > 1 else (noted,):
        options = {"script": "latin", "sizes": [1, 2], "annotations": annotations}
        slow, _ = train_eval.model_predictions(rows, k, ["MultinomialNB"], **options)
        fast = train_eval.full_bayes_predictions(rows, k, **options)
        seen = [{(r.msg_id, r.fold, r.label, r.predicted) for r in df.collect()} for df in (slow, fast)]
        assert seen[0] == seen[1] and len(seen[0]) > 10
        if k == 1:  # and the same scores
            folded = features.annotate(cut_lineage(add_folds(rows, 1, "text")), annotations)
            train, test = folded.where("fold <> 0"), folded.where("fold = 0")
            vectors = features.Vectoriser([1, 2], script="latin", annotated=True).fit(train, classwords.class_words(train, script="latin"))
            scored = NaiveBayes(modelType="multinomial").fit(vectors.transform(train)).transform(vectors.transform(test))
            wanted = {r.msg_id: tuple(r.rawPrediction) for r in scored.select("msg_id", "rawPrediction").collect()}
            assert {r.msg_id: (r.score0, r.score1) for r in fast.collect()} == {i: pytest.approx(x) for i, x in wanted.items()}


def test_class_words_of_all_folds(spark):
    rng = random.Random(8)
    data = [(i, i % 4, rng.randint(0, 1), " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "f"]) for _ in range(6))) for i in range(60)]
    rows = cut_lineage(spark.createDataFrame(data, "msg_id long, fold int, label int, text string"))
    bags = classwords.fold_class_words(rows, range(4), script="latin", min_count=22, top=2)
    hits = classwords.fold_class_word_hits(rows, bags, script="latin")
    found = {(r.asked, r.msg_id): (r.non_spam_words, r.spam_words) for r in hits.collect()}
    for fold in range(4):
        bag = classwords.class_words(rows.where(F.col("fold") != fold), script="latin", min_count=22, top=2)
        assert {(r.label, r.word, r.n) for r in bag.collect()} == {(r.label, r.word, r.n) for r in bags.where(F.col("fold") == fold).collect()}
        for r in classwords.class_word_hits(rows, bag, script="latin").collect():
            assert found.get((fold, r.msg_id), (0, 0)) == (r.non_spam_words, r.spam_words)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"שלום http://x.example/{i}\nmail me@x.example\n", encoding="utf-8")
    stream = clean_stream.clean(clean_stream.read_messages(spark, str(source), files_per_batch=1))
    clean_stream.write_messages(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = clean_stream.clean(spark.read.text(str(source)).select(F.col("value").alias("text")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert censor(batch.select("text")).count() == 6
