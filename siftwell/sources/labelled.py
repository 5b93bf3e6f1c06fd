"""Labelled text files, one message per line, and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import patterns as P


def label_lines(lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """Adds dataset and label (0 non-spam, 1 spam), both read from .../<dataset>/{spam,non_spam}.txt or from a
    folder dataset=<dataset>/label=<label>; lines are stripped and blank ones dropped."""
    name = r"([^/]+)/(non_spam|spam)\.txt$"
    folder = r"dataset=([^/]+)/label=([01])/"
    by_name = F.regexp_extract(F.col(path), name, 2)
    return (
        lines.withColumn(
            "dataset",
            F.when(by_name != "", F.regexp_extract(F.col(path), name, 1)).otherwise(
                F.regexp_extract(F.col(path), folder, 1)
            ),
        )
        .withColumn(
            "label",
            F.when(by_name == "spam", 1)
            .when(by_name == "non_spam", 0)
            .otherwise(F.expr(f"try_cast(regexp_extract({path}, '{folder}', 2) AS int)")),
        )
        .withColumn("text", F.btrim(F.col(line), F.lit(P.SPACES)))
        .where(F.col("text") != "")
        .drop(*{path, line} - {"text"})
    )


def read_labelled(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """messages(msg_id, dataset, label, text). msg_id is a hash of path and line, so it does not depend on how files are
    split; equal lines of a file share it, as they share their place in every fold and cap."""
    lines = spark.read.text(paths).select(
        F.xxhash64("_metadata.file_path", "value").alias("msg_id"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("line"),
    )
    return label_lines(lines)


def write_text(messages: DataFrame, folder: str, files: int | None = None) -> None:
    """One message per line under dataset=/label=, overwriting. Rows are written where they are, unless a number of
    files is given: then they are first dealt out evenly, not by dataset or label."""
    rows = messages.repartition(files) if files else messages
    rows.select("dataset", "label", "text").write.mode("overwrite").partitionBy("dataset", "label").text(folder)
