"""Mailboxes: one record per mail, parsed where it lies. Python only for MIME, which Spark has no function for."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.header import decode_header
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.masks import with_subject

PIECE = 64  # mails of a batch that are parsed at a time
PARSED = "subject string, body string, error string"


def _plain_body(mail: email.message.Message) -> str | None:
    """The last text/plain part."""
    plain = [p for p in mail.walk() if not p.is_multipart() and p.get_content_type() == "text/plain"]
    if not plain:
        return None
    return unquote(plain[-1].get_payload(decode=True).decode("utf-8"))


def _first_subject(mail: email.message.Message) -> str:
    first = decode_header(mail["subject"])[0][0]
    return unquote(first.decode("utf-8") if isinstance(first, bytes) else first)


def _parse(raw: bytes) -> tuple[str | None, str | None, str | None]:
    try:
        mail = email.message_from_bytes(raw)
        body = _plain_body(mail)
        if body is None:
            return None, None, "no plain text"
        return _first_subject(mail), body, None
    except Exception as e:  # a bad mail is a row of the rejects table
        return None, None, type(e).__name__


def parse_mails(
    raw: DataFrame, mail: str = "raw", keep: tuple[str, ...] = ("path", "msg_no"), from_line: bool = False
) -> DataFrame:
    """keep columns + subject, body, error. A mail is parsed as bytes, since its parts may be in any charset; bodies that
    are not UTF-8 are errors. With from_line the first line is not part of the mail. A double CRLF in the body becomes
    one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(at, PIECE) for at in range(0, batch.num_rows, PIECE)):
                mails = (r.as_py() for r in piece.column(len(keep)))
                parsed = [_parse(r.partition(b"\n")[2] if from_line else r) for r in mails]
                texts = [pa.array(c, pa.string()) for c in zip(*parsed, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], *texts], [*piece.schema.names[: len(keep)], "subject", "body", "error"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.select(*keep).schema)
    out = raw.select(*keep, F.col(mail).cast("binary").alias(mail)).mapInArrow(run, f"{kept}, {PARSED}")
    return out.withColumn("body", F.regexp_replace("body", "\r\n\r\n", "\r\n"))


def read_mbox(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per mail as bytes, with its "From " line. Files are split like any text file; msg_no is a hash of path
    and mail, so it does not depend on the splits."""
    mails = spark.read.text(paths, lineSep="\nFrom ")
    return mails.select(
        F.col("_metadata.file_path").alias("path"),
        F.xxhash64("_metadata.file_path", F.col("value").cast("binary")).alias("msg_no"),
        F.col("value").cast("binary").alias("raw"),
    )


def mail_messages(parsed: DataFrame) -> DataFrame:
    """messages_raw rows of the mails that could be read."""
    return parsed.where(F.col("error").isNull()).select(
        F.lit("mail").alias("source"), "path", "msg_no", F.lit(None).cast("string").alias("sender"),
        F.lit(None).cast("timestamp").alias("sent_at"), "subject",
        with_subject(F.col("subject"), F.col("body")).alias("body"),
    )


def mail_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("path", "msg_no", "error")
