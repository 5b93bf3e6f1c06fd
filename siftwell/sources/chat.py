"""Chat exports: lines to messages. Files are read by splits, so that one huge export is not one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftwell.functions import patterns as P
from siftwell.functions.text import drop_direction_marks
from siftwell.operators.clean import holds_any, keep_script, split_on_blank_line


def read_chat_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """chat_lines(path, block, line_no, line): block is where the split starts in the file, line_no orders the lines
    of a block."""
    return (
        spark.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_no"),
            F.regexp_replace("value", r"\r$", "").alias("line"),
        )
    )


def messages_from_lines(lines: DataFrame, phrases: Sequence[str] = ()) -> DataFrame:
    """messages_raw(source, path, msg_no, sender, sent_at, subject, body): a header line opens a message, the lines
    up to the next header belong to it, lines before the first header are skipped. Lines with one of the phrases are
    left out after that, and so are messages without any other line.

    Headers are numbered inside each block and moved by the number of headers in the blocks before, so a window sees
    one block of lines, or one row per block of a file, never a whole file of lines."""
    line = drop_direction_marks(F.col("line"))
    part = {name: F.regexp_extract(line, P.CHAT_HEADER, i + 1) for i, name in enumerate("d m y hh mm ss who".split())}
    opened = lines.withColumn("_head", line.rlike(P.CHAT_HEADER))
    sizes = opened.groupBy("path", "block").agg(F.count_if("_head").alias("_n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("path", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    stamp = F.format_string("%s.%s.%s %s:%s:%s", *[part[c] for c in ("d", "m", "y", "hh", "mm", "ss")])
    numbered = (
        opened.withColumn("_r", F.count_if("_head").over(inside))
        .join(offsets, ["path", "block"])
        .withColumn("msg_no", F.col("_offset") + F.col("_r") - 1)
        .where(F.col("msg_no") >= 0)
        .withColumn("sender", F.when(F.col("_head"), part["who"]))
        .withColumn("sent_at", F.when(F.col("_head"), F.try_to_timestamp(stamp, F.lit("d.M.y H:m:s"))))
        .withColumn("line", F.when(F.col("_head"), F.regexp_replace(line, P.CHAT_HEADER, "")).otherwise(F.col("line")))
    )
    row = F.struct("block", "line_no", "line")
    ordered = F.array_sort(F.collect_list(F.when(~holds_any(F.col("line"), phrases), row)))
    return (
        numbered.groupBy("path", "msg_no")
        .agg(F.max("sender").alias("sender"), F.max("sent_at").alias("sent_at"), ordered.alias("_lines"))
        .where(F.size("_lines") > 0)
        .select(
            F.lit("chat").alias("source"), "path", "msg_no", "sender", "sent_at",
            F.lit(None).cast("string").alias("subject"),
            F.array_join(F.col("_lines.line"), "\n").alias("body"),
        )
    )


def read_chat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return messages_from_lines(read_chat_lines(spark, paths))


def parse_whole_exports(exports: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The same for exports that are one row each (wholetext): narrow, for many small files."""
    head = P.CHAT_HEADER.replace("^", "(?m)^", 1)
    parts = F.split(drop_direction_marks(F.col(text)), f"(?={head})")
    opened = F.filter(parts, lambda p: p.rlike(P.CHAT_HEADER))
    rows = exports.select(F.col(path).alias("path"), F.posexplode(opened).alias("msg_no", "_msg"))
    part = [F.regexp_extract("_msg", P.CHAT_HEADER, i) for i in range(1, 8)]
    return rows.select(
        F.lit("chat").alias("source"), "path", F.col("msg_no").cast("bigint").alias("msg_no"), part[6].alias("sender"),
        F.try_to_timestamp(F.format_string("%s.%s.%s %s:%s:%s", *part[:6]), F.lit("d.M.y H:m:s")).alias("sent_at"),
        F.lit(None).cast("string").alias("subject"),
        F.regexp_replace(F.regexp_replace("_msg", P.CHAT_HEADER, ""), r"\r?\n$", "").alias("body"),
    )


def first_stage(lines: DataFrame, script: str = "hebrew") -> DataFrame:
    """Lines of an export to cleaned messages: service lines out, messages put together, split where exactly one
    blank line stands, kept if the first part has a letter of the script."""
    parts = split_on_blank_line(messages_from_lines(lines, P.SYSTEM_PHRASES))
    own = W.partitionBy("path", "msg_no").orderBy("part_no")
    first = parts.withColumn("_first", F.first("body").over(own))
    return keep_script(first, "_first", script).drop("_first")
