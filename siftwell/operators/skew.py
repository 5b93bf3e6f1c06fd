"""Joins and top-n that hold when one key has a third of all rows. All answers are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.session import cut_lineage

HOT = 1024  # a key is hot above 1/HOT of all rows, so there are fewer than HOT hot keys


def _salt(columns: Sequence[str], n: Column | int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(n) if isinstance(n, int) else n)


def hot_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, salt_by: Sequence[str], how: str = "inner",
    many: bool = False,
) -> DataFrame:
    """Join many rows (left) to one row per key (right), where right[weight] says how often a key occurs on the left.
    With many the right may have several rows per key, all with the key's weight.

    A hot key is cut into as many salts as it has HOT-ths of the rows and its right row is copied once per salt, so
    that no reducer gets more than its share. The list of hot keys is broadcast: it has fewer than HOT rows, because
    the weights add up to the whole."""
    on = list(on)
    total = right.agg(F.sum(weight)).scalar()
    salts = F.ceil(F.col(weight) * HOT / total).cast("bigint")
    marked = right.withColumn("_salts", F.when(F.col(weight) * HOT > total, salts).otherwise(F.lit(1)))
    hot = marked.where(F.col("_salts") > 1).select(*on, F.col("_salts").alias("_cut"))
    hot = hot.distinct() if many else hot
    salted_left = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.when(F.col("_cut").isNull(), F.lit(0)).otherwise(_salt(salt_by, F.col("_cut"))))
        .drop("_cut")
    )
    salted_right = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table of one row per group. The table is written first, so the planner knows its size and broadcasts
    it below Spark's own threshold; beyond that AQE splits the groups that are too large for a task."""
    return left.join(cut_lineage(right), list(on), how)


def sortable(column: Column) -> Column:
    """Whole numbers as strings of one length that sort as the numbers do."""
    return F.lpad((column.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")


def _common_prefix(a: str, b: str, done: Column) -> Column:
    """Length of the common beginning of two strings that share their first `done` letters."""
    most = F.least(F.length(a), F.length(b))
    first_other = F.array_min(F.filter(F.sequence(F.lit(1), most), lambda i: F.substring(F.col(a), F.lit(1), i) != F.substring(F.col(b), F.lit(1), i)))
    return F.greatest(F.when(most == 0, 0).otherwise(F.coalesce(first_other - 1, most)), done)


def last_of_first_n(df: DataFrame, groups: Sequence[str], key: Column, n: int, width: int = 2, small: int = 4096) -> DataFrame:
    """groups, _last: the n-th smallest key of every group, or its greatest if it has fewer rows. Keys are strings, unique
    in a group.

    Histograms of the key's beginning find the bucket that the n-th key lies in; a bucket of more than small rows is refined
    by the next letters that differ. So rows are only counted where they lie, and no task sees more than the buckets of
    a group or small rows of it. A group needs as many rounds as its keys have differing parts before the n-th is told
    from its neighbours."""
    groups = list(groups)
    rows = cut_lineage(df.select(*groups, key.alias("_key")))
    inside = {"_prefix": F.lit(""), "_want": F.lit(n).cast("bigint")}
    open_ = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    sized = cut_lineage(open_.withColumns(inside))
    found = sized.where(F.col("_n") <= F.col("_want")).select(*groups, F.col("_most").alias("_last"))
    open_ = sized.where(F.col("_n") > F.col("_want"))
    by_bucket = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    while not open_.isEmpty():
        cut = (_common_prefix("_least", "_most", F.length("_prefix")) + width).alias("_cut")
        seen = rows.join(open_.select(*groups, "_prefix", "_want", cut), groups).where(F.col("_key").startswith(F.col("_prefix")))
        buckets = seen.groupBy(*groups, "_want", F.substring(F.col("_key"), F.lit(1), F.col("_cut")).alias("_bucket")).agg(
            F.count("*").alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_most")
        )
        upto = buckets.withColumn("_upto", F.sum("_n").over(by_bucket))
        at = cut_lineage(
            upto.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
            .withColumn("_want", F.col("_want") - F.col("_upto") + F.col("_n")).drop("_upto").withColumnRenamed("_bucket", "_prefix")
        )
        ends = at.where(F.col("_n") == F.col("_want")).select(*groups, F.col("_most").alias("_last"))
        # keys that are all the same can't be told apart
        last = (F.col("_n") <= small) | (F.col("_least") == F.col("_most"))
        few = rows.join(at.where(last & (F.col("_n") > F.col("_want"))).select(*groups, "_prefix", "_want"), groups)
        ranked = few.where(F.col("_key").startswith(F.col("_prefix"))).withColumn("_r", F.row_number().over(W.partitionBy(*groups).orderBy("_key")))
        found = found.unionByName(ends).unionByName(ranked.where(F.col("_r") == F.col("_want")).select(*groups, F.col("_key").alias("_last")))
        open_ = at.where(~last & (F.col("_n") > F.col("_want")))
    return found


def first_n_per_group(df: DataFrame, groups: Sequence[str], key: Column, n: int) -> DataFrame:
    """Rows with the n smallest keys of every group, filtered where they lie. Keys are strings, unique in a group; groups
    are not null."""
    last = last_of_first_n(df, groups, key, n)
    return lookup(df, last, groups).where(key <= F.col("_last")).drop("_last")


def dense_index(df: DataFrame, key: Sequence[str], name: str = "idx", hex_digits: int = 3) -> DataFrame:
    """Numbers 0..n-1 without a window over the whole table: rows are ordered by the leading digits of the key's md5
    and then by the key; each bucket is numbered on its own and moved by the rows of the buckets before it.
    There are 16**hex_digits buckets, which bounds the table of offsets."""
    joined = F.concat_ws("|", *[F.col(c) for c in key])
    bucketed = df.withColumn("_bucket", F.substring(F.md5(joined), 1, hex_digits))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy(*key)
    return (
        bucketed.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_r") - 1)
        .drop("_bucket", "_offset", "_r")
    )
