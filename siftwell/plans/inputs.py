"""Messages, chat lines, tagged text and trees derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import fold_of, words
from siftwell.session import spread

PHONES = ["1800-123-456", "*1234", "03-1234567", "052-1234567", "+972521234567", "@972521234567", "12345", "1700123456"]
DASH_AT, PLUS_AT = ".\n", "\nTh"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """messages(msg_id, dataset, lang, text) of all documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), F.col("source").alias("dataset"), "lang", "text")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """messages(msg_id, dataset, label, text): documents with a label."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("msg_id"), F.col("toxic").alias("label"))
    return documents(spark, sf).drop("lang").join(labels, "msg_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """One message per turn: msg_id, conv_id, turn, role, text."""
    c = table(spark, sf, "conversations")
    return c.withColumn("msg_id", F.col("conv_id") * 1000 + F.col("turn"))


def chat_lines(spark: SparkSession, sf: str, system_phrase: str | None = None) -> DataFrame:
    """chat_lines(path, block, line_no, line): every turn as it would stand in an export, one block per turn."""
    head = F.format_string(
        "[%d.%d.2024, %d:%d:%d] %s: ",
        F.col("conv_id") % 28 + 1, F.col("conv_id") % 12 + 1, F.col("turn") % 24, F.col("conv_id") % 60, F.col("turn") % 60,
        F.col("role"),
    )
    if system_phrase:
        head = F.concat(head, F.when(F.col("role") == "system", F.lit(system_phrase)).otherwise(""))
    rows = turns(spark, sf).select(
        F.format_string("chat_%d.txt", "conv_id").alias("path"), F.col("turn").alias("block"), head.alias("_head"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "_line"),
    )
    line = F.when(F.col("line_no") == 0, F.concat("_head", "_line")).otherwise(F.col("_line"))
    return rows.select("path", "block", "line_no", line.alias("line"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged text of every turn: each line is a sentence, its words form a heap-shaped tree, the role is the tag."""
    def word(w, i):  # noqa: ANN001, ANN202
        head = F.floor((i + 1) / 2).cast("string")
        return F.concat(w, F.lit("~"), F.col("role"), F.lit("~"), head, F.lit("~r"), (F.length(w) % 5).cast("string"))

    lines = F.transform(F.split("text", "\n"), lambda s: F.array_join(F.transform(words(s), word), " "))
    return turns(spark, sf).select("msg_id", F.array_join(lines, " . ").alias("text"))


def conversation_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """tokens: a conversation is one sentence, its turns are nodes of a heap-shaped tree, roles are tag and relation."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("msg_id"), F.lit(0).alias("sent_no"), (F.col("turn") + 1).cast("int").alias("tok_no"),
        F.col("role").alias("pos"), F.floor((F.col("turn") + 1) / 2).cast("int").alias("head"), F.col("role").alias("rel"),
    )


def with_phone_and_link(df: DataFrame) -> DataFrame:
    """Text with a phone number and a link behind it, since the tables have few."""
    phone = F.get(F.array(*[F.lit(p) for p in PHONES]), (F.col("msg_id") % len(PHONES)).cast("int"))
    return df.withColumn(
        "text",
        F.concat(
            "text", F.lit(" call "), phone, F.lit(" or ("), phone, F.lit("), see:http://x.example/"),
            F.col("msg_id").cast("string"), F.lit(" www.x.example"),
        ),
    )


def with_blank_lines(df: DataFrame) -> DataFrame:
    """One blank line after a full stop at a line's end, two in place of the blank after "the"."""
    one = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return df.withColumn("text", F.replace(one, F.lit("the "), F.lit("the\n\n\n")))


def rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """predictions(msg_id, model, fold, label, predicted) of three simple rules, for scores that need no training."""
    base = labelled(spark, sf).withColumn("fold", fold_of(F.col("msg_id"), 5))
    rules = {
        "long": F.length("text") > 4000,
        "worthless": F.col("text").contains("worthless"),
        "hash": fold_of(F.col("msg_id"), 7, 2) == 0,
    }
    named = [F.struct(F.lit(n).alias("model"), r.cast("int").alias("predicted")) for n, r in rules.items()]
    return base.select("msg_id", "fold", "label", F.inline(F.array(*named)))
