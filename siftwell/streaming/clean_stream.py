"""Cleaning of incoming messages. The text functions keep no state, so the batch code runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions.style import add_style
from siftwell.operators.censor import censor


def read_messages(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """One message per line of the text files that arrive in the folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.col("value").alias("text"))


def clean(messages: DataFrame, script: str = "hebrew") -> DataFrame:
    """Censored text and style columns, batch or stream."""
    return add_style(censor(messages), script=script)


def write_messages(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, exactly once, then stop; the checkpoint folder must be shared by the executors."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
