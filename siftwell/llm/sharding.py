"""Operator 8: contiguous shards of equal bytes from global prefix sums.

Only keys and sizes move: rows are range-partitioned and sorted by the order columns, each partition sums up as it
streams, the partitions' totals (one row each) give every partition its offset, and a row goes to the shard in whose
share of all bytes the row's middle lies. Shards are intervals of the order and differ from the target by less than
one row.

Defined results: null text has no bytes, so its row has the fixed overhead only. Null ids come first. Rows with equal
order columns are ordered by size and checksum; those equal in all of them are interchangeable. An empty table gives no
rows. With fewer rows than shards some shards stay empty. Columns not asked for are left out, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import table
from siftwell.session import cut_lineage

SHARDS = 40
ROW_OVERHEAD = 16  # bytes that a row takes besides its text


def sized_rows(df: DataFrame, ids: Sequence[str] = ("doc_id",), text: str = "text", overhead: int = ROW_OVERHEAD) -> DataFrame:
    """ids, size (bytes of the text and overhead), text_crc32."""
    data = F.coalesce(df[text], F.lit("")).cast("binary")
    return df.select(
        *(df[c] for c in ids), (F.octet_length(data) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )


def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        ends = total + np.cumsum(sizes)
        n = batch.num_rows
        arrays = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(ends - sizes)]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_part", "_row", "_before"])
        rows, total = rows + n, total + int(sizes.sum())


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """rows (with size and text_crc32) + shard int, slot long (place in the shard, from 0)."""
    keys = [*order, "size", "text_crc32"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int, _row bigint, _before bigint"])
    summed = cut_lineage(ordered.mapInArrow(_running_sums, schema))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        summed.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.sum("_bytes").over(W.partitionBy()).alias("_total"),
        )
    )
    middle = (F.col("_bytes_before") + F.col("_before") + F.col("size") / 2) / F.greatest("_total", F.lit(1))
    placed = summed.join(F.broadcast(parts), "_part").select(
        *rows.columns,
        F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_rows_before") + F.col("_row")).alias("_place"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *rows.columns, "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    placed = shard_by_bytes(sized_rows(table(spark, sf_dir, "documents")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
