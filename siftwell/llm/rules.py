"""Operator 7: quality rules judged by host.

Every text is measured by the base rules, in its row: the words that repeated 3-word windows cover, lines said before,
symbols, length. Failures are summed up by host before they move, a beta prior is fitted to the hosts' rates by their
mean and variance, each host's rate is drawn towards the prior's mean by the prior's weight, and the hosts' verdicts
(one row a host, with the failures of the host's own rows only) are joined back. A rejected host takes all its rows with it.

Defined results: a text that is null, empty or blank has no words, so it fails as too short. A null host is a host of
its own. Repeated rows count each time. With one host, or hosts of equal rates, the prior weighs as much as
MAX_PRIOR_ROWS rows. An empty table gives no rows. Columns not asked for are left out, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import let
from siftwell.llm.common import WORD, table, word_array
from siftwell.operators.skew import hot_join
from siftwell.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5  # a host is rejected if more than this share of its rows fails, after shrinking
MAX_PRIOR_ROWS = 1000.0  # rows that the prior weighs at most


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more in the text. Windows are compared by 64-bit
    hashes, sorted within the row."""

    def covered(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(rows: Column) -> Column:
            n = F.size(rows)
            h = lambda i: F.get(rows, i)["h"]
            same = F.filter(rows, lambda r, i: ((i > 0) & (h(i - 1) == r["h"])) | ((i < n - 1) & (h(i + 1) == r["h"])))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda r: F.array(r["i"], r["i"] + 1, r["i"] + 2)))))

        return let(marked, twins)

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        distinct = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
        return F.when(F.size(w) < 4, 0).otherwise(let(windows, distinct))

    return let(words, count)


def base_rules(df: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, _host, _no_host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, row by row."""
    body = F.coalesce(df[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    measured = df.select(
        df["doc_id"],
        F.coalesce(df[host], F.lit("")).alias("_host"),
        df[host].isNull().alias("_no_host"),
        word_array(body).alias("_words"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    )
    counted = measured.select(
        "doc_id",
        "_host",
        "_no_host",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
    )
    too_short, repeats = F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return counted.withColumn("base_failed", too_short | repeats)


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_host, _no_host, rows, failures, rate (shrunk), host_rejected: one row per host."""
    hosts = judged.groupBy("_host", "_no_host").agg(
        F.count("*").alias("rows"), F.sum(F.col("base_failed").cast("bigint")).alias("failures")
    )
    prior = hosts.agg(
        F.avg(F.col("failures") / F.col("rows")).alias("_mean"), F.var_samp(F.col("failures") / F.col("rows")).alias("_var")
    )
    spread = F.when(F.col("_var") > 0, F.col("_mean") * (1 - F.col("_mean")) / F.col("_var") - 1)
    weight = F.greatest(F.lit(0.0), F.least(F.coalesce(spread, F.lit(MAX_PRIOR_ROWS)), F.lit(MAX_PRIOR_ROWS)))
    prior = prior.select("_mean", weight.alias("_weight"))  # one row
    rate = (F.col("failures") + F.col("_mean") * F.col("_weight")) / (F.col("rows") + F.col("_weight"))
    return (
        hosts.join(F.broadcast(prior))
        .withColumn("rate", rate)
        .select("_host", "_no_host", "rows", "failures", "rate", (F.col("rate") > max_rate).alias("host_rejected"))
    )


def judge(df: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The base rules' columns, host_rejected and kept, one row for each row of df."""
    judged = cut_lineage(base_rules(df, host, text))
    verdicts = cut_lineage(host_verdicts(judged, max_rate))
    joined = hot_join(judged, verdicts, ["_host", "_no_host"], "rows", ["doc_id", "n_words", "word_chars"])
    return joined.drop("_host", "_no_host", "rows", "failures", "rate").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected")
    )


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    return judge(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source),
prior AS (
  SELECT avg(f / n) AS m,
         greatest(0.0, least(1000.0, coalesce(CASE WHEN var_samp(f / n) > 0 THEN avg(f / n) * (1 - avg(f / n)) / var_samp(f / n) - 1 END, 1000.0))) AS s
  FROM hosts),
verdicts AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""
