"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.session import scratch_dir

#: Keys that may be sent to every task, at most; more are joined by a shuffle.
BROADCAST_KEYS = 4_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a lost executor costs nothing.

    The driver's garbage is collected afterwards, since Spark keeps the shuffle files of a finished job on the
    executors' disks until the driver has dropped its objects; and before, since a job just ended is still held then.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _collected(spark)
    df.write.parquet(path)
    _collected(spark)
    return spark.read.schema(df.schema).parquet(path)


def _collected(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def having(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (distinct, stored), without moving ``df`` while these are few."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
