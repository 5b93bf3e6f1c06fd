"""Caps, splits and folds. All are seeded hashes of the row's key, so they do not depend on the layout of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions.text import fold_of, seeded_key
from siftwell.operators.skew import last_of_first_n, lookup, sortable


def cap_per_class(
    df: DataFrame, caps: dict[int, int | None], groups: Sequence[str] = ("dataset", "label"), id_col: str = "msg_id"
) -> DataFrame:
    """First rows by id of every group, as many as caps says for the label (None or 0: all). The last id of each group is
    found by histograms of the ids, and rows are filtered by it where they lie. Ids are whole numbers, unique in a
    group; groups are not null."""
    limited = {label: n for label, n in caps.items() if n}
    out = df
    key = sortable(F.col(id_col))
    for label, n in limited.items():
        last = last_of_first_n(df.where(F.col("label") == label).select(*groups, id_col), groups, key, n)
        out = (
            lookup(out, last, groups, "left")
            .where((F.col("label") != label) | (key <= F.col("_last")))
            .drop("_last")
        )
    return out


def shuffle_rows(df: DataFrame, key: str = "msg_id", seed: int = 1) -> DataFrame:
    """Random order, the same in every run; shuffle_key is what it is ordered by."""
    return df.withColumn("shuffle_key", seeded_key(F.col(key), seed)).orderBy("shuffle_key", key)


def stratified_split(
    df: DataFrame, fraction: float, strata: Sequence[str] = ("label",), key: str = "msg_id", seed: int = 1,
    hex_digits: int = 3,
) -> DataFrame:
    """is_test = 1 for exactly round(fraction * n) rows of every stratum, those with the smallest seeded keys.

    The key that ends the test part is found by a histogram over leading digits and a sort inside one bucket, so no
    task sees a whole stratum and no text is shuffled."""
    strata = list(strata)
    ids = df.select(*strata, seeded_key(F.col(key), seed).alias("_key"))
    bucket = F.substring("_key", 1, hex_digits).alias("_bucket")
    counts = ids.groupBy(*strata, bucket).agg(F.count("*").alias("_n"))
    by_stratum = W.partitionBy(*strata)
    upto = by_stratum.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_want", F.floor(F.sum("_n").over(by_stratum) * F.lit(fraction) + 0.5))
        .withColumn("_upto", F.sum("_n").over(upto))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*strata, "_bucket", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    inside = lookup(ids.withColumn("_bucket", bucket), cut, [*strata, "_bucket"])
    last = (
        inside.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy("_key")))
        .where(F.col("_r") == F.col("_rest"))
        .select(*strata, F.col("_key").alias("_last"))
    )
    return (
        lookup(df, last, strata, "left")
        .withColumn("is_test", F.coalesce((seeded_key(F.col(key), seed) <= F.col("_last")).cast("int"), F.lit(0)))
        .drop("_last")
    )


def add_folds(df: DataFrame, k: int, key: str = "msg_id", seed: int = 1, fraction: float = 0.25) -> DataFrame:
    """fold 0..k-1; training rows of fold i are those with another fold. k <= 1 is one stratified hold-out: its test
    rows are fold 0, the others fold -1."""
    if k > 1:
        return df.withColumn("fold", fold_of(F.col(key), k, seed))
    return stratified_split(df, fraction, key=key, seed=seed).withColumn("fold", F.col("is_test") - 1).drop("is_test")
