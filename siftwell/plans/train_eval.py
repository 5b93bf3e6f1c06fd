"""Whole jobs: naive Bayes over folds, the five models over folds, the experiment grid."""

from __future__ import annotations

import functools
import time
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import bayes, evaluate
from siftwell.operators.censor import censor
from siftwell.functions.style import STYLE_COLUMNS, add_style
from siftwell.functions.text import has_script
from siftwell.operators.classwords import fold_class_word_hits, fold_class_words
from siftwell.operators.clean import drop_rejected
from siftwell.operators.dedup import prune_datasets, union_datasets
from siftwell.operators.evaluate import fold_scores, fold_summary
from siftwell.operators.features import SCALARS, TREE_SCALARS, FoldVectors, annotate, annotation_features, term_array, unpivot_scalars
from siftwell.operators.models import LINEAR, MODEL_NAMES, classifiers, fit_and_predict
from siftwell.operators.ngrams import explode_ngrams
from siftwell.operators.sampling import add_folds, cap_per_class
from siftwell.session import cut_lineage
from siftwell.sources.tagged import plain_from_tagged


def once_per_class(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """A text stands once in a class, under its smallest id."""
    return messages.groupBy("label", "text").agg(F.min(key).alias(key))


def bayes_predictions(
    messages: DataFrame, k: int = 5, sizes: Sequence[int] = (1,), kinds: Sequence[str] = ("word",),
    key: str = "msg_id", fraction: float = 0.25,
) -> DataFrame:
    """predictions of naive Bayes over n-gram presence for every fold, in one job. messages(msg_id, label, text). Folds go
    by text, so none is in two of them."""
    folded = cut_lineage(add_folds(once_per_class(messages, key), k, "text", fraction=fraction))
    grams = explode_ngrams(folded, kinds=kinds, sizes=sizes, keep=["msg_id", "fold", "label"], distinct=True)
    features = grams.select(
        "msg_id", "fold", "label", F.concat("kind", F.lit(":"), "term").alias("term"), F.lit(1.0).alias("value")
    )
    scored = bayes.cross_validate(features, folded.select("msg_id", "fold", "label"))
    return scored.withColumn("model", F.lit("MultinomialNB"))


def full_bayes_predictions(
    messages: DataFrame, k: int = 5, script: str = "hebrew", sizes: Sequence[int] = (1, 2, 3), kinds: Sequence[str] = ("word", "letter"),
    fraction: float = 0.25, annotations: DataFrame | None = None,
) -> DataFrame:
    """predictions of naive Bayes on all that Vectoriser gives the models: n-grams, style, class words of the training rows,
    tags and trees. One job for all folds; terms stay rows, so no vocabulary comes to the driver. A message without a letter of
    the script has nothing but the class shares; its terms are known, with a value of zero."""
    rows = once_per_class(messages) if annotations is None else messages
    folded = cut_lineage(add_folds(rows, k, "text", fraction=fraction))
    return _full_bayes(folded, list(range(k)) if k > 1 else [0], script, sizes, kinds, annotations)


def _full_bayes(
    folded: DataFrame, folds: list[int], script: str, sizes: Sequence[int], kinds: Sequence[str], annotations: DataFrame | None
) -> DataFrame:
    """full_bayes_predictions of messages that have their fold; only predictions for the given folds are complete."""
    keep = ["msg_id", "fold", "label"]
    ok = has_script(F.col("text"), script)
    own = folded.where(ok)
    # the value is found once a message, below the explode, so that no term carries its text along; outer, because for an
    # inner explode Spark adds a filter on the array, which would compute the array again
    listed = folded.select(*keep, ok.cast("double").alias("value"), term_array("text", sizes, kinds).alias("_terms"))
    features = listed.select(*keep, F.explode_outer("_terms").alias("term"), "value").where("term IS NOT NULL")
    for_all, names = [unpivot_scalars(add_style(own, script=script), STYLE_COLUMNS, "style", keep)], SCALARS
    if annotations is not None:
        noted = cut_lineage(annotate(folded.select(*keep, ok.alias("_ok")), annotations))
        counted = noted.select(*keep, "_ok", F.inline("counted"))
        features = features.unionByName(counted.select(*keep, "term", F.when(F.col("_ok"), F.col("n")).otherwise(0).cast("double").alias("value")))
        shape = noted.where("_ok").select(*keep, *[F.coalesce(c, F.lit(0)).alias(c) for c in TREE_SCALARS])
        for_all, names = [*for_all, unpivot_scalars(shape, TREE_SCALARS, "style", keep)], [*SCALARS, *TREE_SCALARS]
    hits = fold_class_word_hits(own, fold_class_words(folded, folds, script=script), script=script)
    parts = [p.withColumn("asked", F.lit(None).cast("int")) for p in for_all]
    parts.append(unpivot_scalars(hits, ["non_spam_words", "spam_words"], "style", [*keep, "asked"]))
    numbers = functools.reduce(DataFrame.unionByName, parts).drop("kind").where("value <> 0")
    scored = bayes.cross_validate_with_numbers(features, cut_lineage(numbers), folded.select(*keep), folds, len(names))
    return scored.withColumn("model", F.lit("MultinomialNB"))


def spam_scores(messages: DataFrame, k: int = 5) -> DataFrame:
    """Raw labelled messages to the fold summary of naive Bayes on words: the flagship job."""
    return fold_summary(fold_scores(bayes_predictions(censor(messages), k)))


def run_report(messages: DataFrame, predictions: DataFrame, convention: str = "paper") -> DataFrame:
    """(section, model, item, value), all that a run is judged by: baseline accuracy of the messages, accuracy and margin
    of every fold, the class report, summaries and the number of folds above one by lambda, and the list of errors (item:
    message and wrong class). messages(label, text), predictions(msg_id, model, fold, label, predicted)."""
    kept = cut_lineage(predictions)
    scores = cut_lineage(evaluate.fold_scores(kept, convention=convention))
    base = evaluate.baseline_accuracy(messages)
    folds = evaluate.accuracy(kept, base.select("baseline").scalar())

    def part(df: DataFrame, columns: dict[str, str], model: Column, item: Column) -> DataFrame:
        values = [F.struct(F.lit(name).alias("section"), F.col(c).cast("double").alias("value")) for c, name in columns.items()]
        rows = df.select(model.alias("model"), item.cast("string").alias("item"), F.inline(F.array(*values)))
        return rows.select("section", "model", "item", "value")

    model, by_lambda = F.col("model"), F.col("lambda")
    names = {c: c for c in ("f1_mean", "f1_low", "wacc_mean", "wacc_low", "tcr_mean", "tcr_low")}
    error = F.concat_ws(" ", F.col("msg_id").cast("string"), F.col("predicted").cast("string"))
    parts = [
        part(base, {"baseline": "baseline"}, F.lit(""), F.lit("")),
        part(folds, {"accuracy": "accuracy", "margin": "margin"}, model, F.col("fold")),
        part(evaluate.class_report(kept), {c: c for c in ("precision", "recall", "f1", "support")}, model, F.col("class")),
        part(fold_summary(scores), names, model, by_lambda),
        part(evaluate.folds_above_one(scores), {"n_folds": "folds_above_one"}, model, by_lambda),
        part(evaluate.error_report(kept, ordered=False), {"n": "error"}, model, error),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def model_predictions(
    messages: DataFrame, k: int = 5, names: Sequence[str] = MODEL_NAMES, folds: Sequence[int] | None = None,
    script: str = "hebrew", sizes: Sequence[int] = (1, 2, 3), kinds: Sequence[str] = ("word", "letter"),
    rounds: int = 50, max_iter: int = 100, fraction: float = 0.25,
    annotations: DataFrame | None = None,
) -> tuple[DataFrame, list[tuple[str, int, float]]]:
    """(msg_id, model, fold, label, predicted) and fit times. Per fold the class words come from the
    training rows, and all folds and models share one kept table of terms, numbers and vectors. Naive Bayes takes its one-pass form, so each fold has an
    equal share of its seconds; only the linear models have a vocabulary, one for all folds. annotations: see annotation_features."""
    # messages with annotations may differ in these alone
    rows = once_per_class(messages) if annotations is None else messages
    folded = cut_lineage(add_folds(rows, k, "text", fraction=fraction))
    out, timings = None, []
    asked = list(folds if folds is not None else (range(k) if k > 1 else [0]))
    others = classifiers([n for n in names if n != "MultinomialNB"], rounds, max_iter)
    if "MultinomialNB" in names and asked:
        start = time.time()
        no_label = F.raise_error(F.lit("Labels MUST NOT be Null")).cast("int")  # as MLlib has it
        scored = _full_bayes(folded.withColumn("label", F.coalesce("label", no_label)), asked, script, sizes, kinds, annotations).where(F.col("fold").isin(asked))
        out = cut_lineage(scored.select("msg_id", "model", "fold", "label", "predicted"))
        seconds = round((time.time() - start) / len(asked), 3)
        timings += [("MultinomialNB", fold, seconds) for fold in asked]
    if annotations is not None:
        folded = annotate(folded, annotations)
    made = None
    if others and asked:
        made = FoldVectors(folded, asked, sizes, kinds, script, annotated=annotations is not None, vectors=any(n in LINEAR for n in others))

    def of_fold(fold: int) -> tuple[DataFrame, list[tuple[str, int, float]]]:
        rows = made.of_fold(fold)
        return fit_and_predict(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), others, fold)

    if made:
        at_once = min(made.fits_at_once(), len(asked)) if set(others) <= set(LINEAR) else 1
        spark = messages.sparkSession
        with ThreadPool(at_once) as pool:
            for predicted, times in pool.map(inheritable_thread_target(spark)(of_fold), asked, chunksize=1):
                out = predicted if out is None else out.unionByName(predicted)
                timings += times
    return out, timings


def model_set(messages: DataFrame, fraction: float = 0.25, names: Sequence[str] = MODEL_NAMES, **options: object) -> DataFrame:
    """(model, n_test, n_right, seconds): the models on one hold-out of the messages, on the same vectors, and how long
    each took to fit and predict. options: see model_predictions."""
    predicted, timings = model_predictions(messages, 1, names, fraction=fraction, **options)
    right = predicted.groupBy("model").agg(
        F.count("*").alias("n_test"), F.count_if(F.col("label") == F.col("predicted")).alias("n_right")
    )
    times = messages.sparkSession.createDataFrame([(m, s) for m, _, s in timings], "model string, seconds double")  # a row per model
    return right.join(F.broadcast(times), "model")


@dataclass(frozen=True)
class Run:
    """One row of an experiment grid. model 0 is all five; caps and union as in the data stage. A morphological run
    takes tagged text, and only it can have tag and tree features."""

    model: int = 1
    k: int = 5
    split: float = 0.25
    spam_cap: int | None = None
    non_spam_cap: int | None = None
    union: bool = False
    morphological: bool = False
    tags: bool = False
    trees: bool = False


def _datasets(messages: DataFrame, run: Run) -> list[tuple[str, DataFrame]]:
    if run.morphological:
        messages = drop_rejected(messages)
    capped = cap_per_class(messages, {1: run.spam_cap, 0: run.non_spam_cap})
    full = prune_datasets(capped)
    names = [r.dataset for r in full.select("dataset").distinct().orderBy("dataset").collect()]  # one job each
    parts = {n: full.where(F.col("dataset") == n) for n in names}
    if run.union and len(parts) > 1:
        first, *others = parts.values()
        for other in others:
            first = union_datasets(first, other)
        return [("both", first)]
    return list(parts.items())


def run_grid(messages: DataFrame, runs: Sequence[Run], **vector_options: object) -> DataFrame:
    """Summary rows of every run and dataset, with the run's parameters and sizes. messages(msg_id, dataset, label,
    text). Runs are independent jobs; naive Bayes alone takes the one-pass form, on the same features."""
    out = None
    for_bayes = {o: vector_options[o] for o in ("script", "sizes", "kinds") if o in vector_options}
    for run_id, run in enumerate(runs):
        for name, rows in _datasets(messages, run):
            start = time.time()
            noted = None
            if run.morphological:
                rows = once_per_class(rows)
                if run.tags or run.trees:
                    noted = annotation_features(rows, run.tags, run.trees)
                rows = rows.withColumn("text", plain_from_tagged(F.col("text")))
            if run.model == 1:
                predicted = full_bayes_predictions(rows, run.k, fraction=run.split, annotations=noted, **for_bayes)
            else:
                names = MODEL_NAMES if run.model == 0 else [MODEL_NAMES[run.model - 1]]
                predicted, _ = model_predictions(rows, run.k, names, fraction=run.split, annotations=noted, **vector_options)
            summary = fold_summary(fold_scores(predicted))
            sizes = rows.agg(
                F.count("*").alias("n_messages"), F.count_if(F.col("label") == 1).alias("n_spam"),
                F.count_if(F.col("label") == 0).alias("n_non_spam"),
            )
            row = summary.join(F.broadcast(sizes)).select(  # one row of sizes
                F.lit(run_id).alias("run_id"), F.lit(name).alias("dataset"), F.lit(run.k).alias("k"),
                F.lit(run.split).alias("split"), F.lit(run.union).alias("is_union"),
                F.lit(run.morphological).alias("is_morphological"), F.lit(run.morphological and run.tags).alias("has_tags"),
                F.lit(run.morphological and run.trees).alias("has_trees"),
                F.lit(run.spam_cap).cast("int").alias("spam_cap"), F.lit(run.non_spam_cap).cast("int").alias("non_spam_cap"),
                F.lit(round(time.time() - start, 3)).alias("plan_seconds"), "n_messages", "n_spam", "n_non_spam", "model",
                "lambda", "f1_mean", "f1_low", "wacc_mean", "wacc_low", "tcr_mean", "tcr_low",
            )
            out = row if out is None else out.unionByName(row)
    return out


