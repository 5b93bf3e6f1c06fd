"""Scores over predictions(msg_id, dataset, model, fold, label, predicted). Label 0 is non-spam, 1 is spam.

convention="paper": positives are spam, totals are those of the true class, lambda weighs non-spam called spam.
convention="as_written": the transposed reading, where FP and FN change places in the weighted scores, "recall" is
the share of non-spam kept and "precision" the share of spam caught."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAMBDAS = (1, 99, 999)  # fixed values


def baseline_accuracy(messages: DataFrame, text: str = "text") -> DataFrame:
    """Non-spam messages over different messages of both classes; within a class a text counts once."""
    per_text = messages.groupBy(text).agg(F.max(F.when(F.col("label") == 0, 1).otherwise(0)).alias("_ham"))
    return per_text.agg(
        F.sum("_ham").alias("n_non_spam"), F.count("*").alias("n_distinct"),
        F.try_divide(F.sum("_ham").cast("double"), F.count("*")).alias("baseline"),
    )


def accuracy(predictions: DataFrame, baseline: float | Column | None = None) -> DataFrame:
    """(model, fold, accuracy[, margin])."""
    hit = (F.col("label") == F.col("predicted")).cast("double")
    out = predictions.groupBy("model", "fold").agg(F.avg(hit).alias("accuracy"))
    return out if baseline is None else out.withColumn("margin", F.col("accuracy") - baseline)


def confusion(predictions: DataFrame) -> DataFrame:
    """(model, fold, tn, fp, fn, tp)."""
    def n(label: int, predicted: int) -> Column:
        return F.count_if((F.col("label") == label) & (F.col("predicted") == predicted))

    return predictions.groupBy("model", "fold").agg(
        n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _swapped(matrix: DataFrame, convention: str) -> DataFrame:
    if convention not in ("paper", "as_written"):
        raise ValueError(convention)
    if convention == "paper":
        return matrix
    return matrix.withColumns({"fp": F.col("fn"), "fn": F.col("fp")})


def f1_scores(matrix: DataFrame, convention: str = "paper") -> DataFrame:
    """Adds recall, precision, f1; NULL where there is nothing to divide by."""
    if convention == "paper":
        recall, precision = _ratio(F.col("tp"), F.col("tp") + F.col("fn")), _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    else:
        recall, precision = _ratio(F.col("tn"), F.col("tn") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return matrix.withColumns({"recall": recall, "precision": precision}).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def weighted_scores(matrix: DataFrame, lambdas: Sequence[int] = LAMBDAS, convention: str = "paper") -> DataFrame:
    """One row per lambda, with wacc and tcr. TCR is NULL if there is no weighted error."""
    m = _swapped(matrix, convention).withColumn("lambda", F.explode(F.array(*[F.lit(x) for x in lambdas])))
    lam = F.col("lambda")
    wacc = _ratio(lam * F.col("tn") + F.col("tp"), lam * (F.col("tn") + F.col("fp")) + F.col("tp") + F.col("fn"))
    tcr = _ratio(F.col("tp") + F.col("fn"), lam * F.col("fp") + F.col("fn"))
    keep = [c for c in matrix.columns if c not in ("tn", "fp", "fn", "tp")]
    return m.withColumns({"wacc": wacc, "tcr": tcr}).select(*keep, "lambda", "wacc", "tcr")


def class_report(predictions: DataFrame) -> DataFrame:
    """Per model: precision, recall, f1, support of class 0 and 1, and rows macro and weighted. 0 where there is
    nothing to divide by."""
    m = predictions.withColumn("fold", F.lit(0)).transform(confusion)
    per_class = m.select(
        "model",
        F.inline(
            F.array(
                F.struct(F.lit("0").alias("class"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("called"), (F.col("tn") + F.col("fp")).alias("support")),
                F.struct(F.lit("1").alias("class"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("called"), (F.col("tp") + F.col("fn")).alias("support")),
            )
        ),
    )
    zero = F.lit(0.0)
    p = F.coalesce(_ratio(F.col("hit"), F.col("called")), zero)
    r = F.coalesce(_ratio(F.col("hit"), F.col("support")), zero)
    scored = per_class.select("model", "class", p.alias("precision"), r.alias("recall"), "support").withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    )
    names = ["precision", "recall", "f1"]
    means = scored.groupBy("model").agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
        F.sum("support").alias("support"),
    )
    rows = means.select(
        "model",
        F.inline(
            F.array(*[
                F.struct(F.lit(k).alias("class"), *[F.col(f"{k}_{c}").alias(c) for c in names], F.col("support"))
                for k in ("macro", "weighted")
            ])
        ),
    )
    return scored.select("model", "class", *names, "support").unionByName(rows.select("model", "class", *names, "support"))


def fold_scores(predictions: DataFrame, lambdas: Sequence[int] = LAMBDAS, convention: str = "paper") -> DataFrame:
    """scores(model, fold, recall, precision, f1, lambda, wacc, tcr)."""
    m = confusion(predictions)
    scored = f1_scores(m, convention)
    return weighted_scores(scored, lambdas, convention)


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and lowest value over the folds, rounded to 4, one row per model and lambda. NULLs are skipped."""
    names = ["f1", "wacc", "tcr"]
    return scores.groupBy("model", "lambda").agg(
        *[F.round(F.avg(c), 4).alias(f"{c}_mean") for c in names], *[F.round(F.min(c), 4).alias(f"{c}_low") for c in names]
    )


def summary_by_lambda(scores: DataFrame, lambdas: Sequence[int] = LAMBDAS) -> DataFrame:
    """The same with one row per model and a column per score and lambda."""
    cols = []
    for lam in lambdas:
        for c in ("wacc", "tcr"):
            x = F.when(F.col("lambda") == lam, F.col(c))
            cols += [F.round(F.avg(x), 4).alias(f"{c}_{lam}_mean"), F.round(F.min(x), 4).alias(f"{c}_{lam}_low")]
    f1 = F.when(F.col("lambda") == lambdas[0], F.col("f1"))
    return scores.groupBy("model").agg(
        F.round(F.avg(f1), 4).alias("f1_mean"), F.round(F.min(f1), 4).alias("f1_low"), *cols
    )


def folds_above_one(scores: DataFrame) -> DataFrame:
    """Number of folds with TCR > 1."""
    return scores.groupBy("model", "lambda").agg(F.count_if(F.col("tcr") > 1).alias("n_folds"))


def error_report(predictions: DataFrame, ordered: bool = True) -> DataFrame:
    """How often each model put a message into each wrong class; wrong class 0 first."""
    wrong = predictions.where(F.col("label") != F.col("predicted"))
    out = wrong.groupBy("msg_id", "predicted", "model").agg(F.count("*").alias("n"))
    return out.orderBy("predicted", "msg_id", "model") if ordered else out
