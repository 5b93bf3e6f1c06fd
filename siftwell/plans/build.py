"""The dataset build as one job: raw messages -> split and filtered -> distinct -> censored -> distinct -> shuffled -> files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions import masks as M
from siftwell.operators.censor import censor
from siftwell.operators.clean import keep_script, split_on_blank_line
from siftwell.operators.dedup import dedup
from siftwell.operators.sampling import shuffle_rows
from siftwell.session import cut_lineage
from siftwell.sources.chat import first_stage
from siftwell.sources.labelled import read_labelled, write_text

CLASS_TEXT = ["dataset", "label", "text"]


def chat_texts(lines: DataFrame, script: str = "hebrew") -> DataFrame:
    """(path, text) of the lines of chat exports: service lines out, split at single blank lines, one script."""
    return first_stage(lines, script).select("path", F.col("body").alias("text"))


def mail_texts(messages: DataFrame, script: str = "hebrew") -> DataFrame:
    """(path, text) of mails that could be read (mailbox.mail_messages)."""
    return keep_script(split_on_blank_line(messages.select("path", "body")), "body", script).select("path", F.col("body").alias("text"))


def build_dataset(
    texts: DataFrame, folder: str, names: Sequence[str] = M.DEFAULT_NAMES, pool: Sequence[str] = M.DEFAULT_POOL, seed: int = 1
) -> DataFrame:
    """texts(dataset, label, text) to one message per line under folder, shuffled by seed; what is written is read back
    as messages. A text is kept once in its class, before and after the censor chain, which can make texts equal; ids are
    hashes of class and text."""
    key = F.xxhash64(*CLASS_TEXT).alias("msg_id")
    distinct = dedup(texts.select(*CLASS_TEXT, key), CLASS_TEXT).drop("n_copies")
    masked = dedup(censor(distinct, names=names, pool=pool, seed=seed), CLASS_TEXT).drop("n_copies")
    shuffled = shuffle_rows(cut_lineage(masked), seed=seed)  # written first, since sorting samples its input
    write_text(shuffled, folder)
    return read_labelled(texts.sparkSession, folder)
