"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", app: str = "siftwell", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"


def _write(df: DataFrame) -> tuple[DataFrame, object, object]:
    """The rows as a table in the shared folder, its path and its file system."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), place, files


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. It is computed once however often it is used, a lost executor costs a
    read, and its size is known to the planner. The table belongs to the application and goes when it ends."""
    return _write(df)[0]


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """cut_lineage for a while: the table goes at the end of the block, so nothing that is computed later may read it."""
    table, place, files = _write(df)
    try:
        yield table
    finally:
        files.delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer splits than the cluster has cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
