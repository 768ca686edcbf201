"""Dense row numbers and first rows in a given order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubrica.session import materialize


def with_row_index(
    df: DataFrame,
    order: list[str],
    name: str = "row_index",
    then: Callable[[DataFrame], DataFrame] = lambda ordered: ordered,
) -> DataFrame:
    """Number rows 0, 1, 2, ... in ``order``.

    Rows are range-partitioned and written with their partition and place; the sizes of the
    partitions before a row's own, one number per partition, complete its index.  ``then`` is
    a row-wise step done in the same write, after the sampling that finds the ranges.
    """
    ranged = then(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = {"_place": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}
    written = materialize(ranged.withColumns(place), "indexed")
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    starts = parts.select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    indexed = written.join(F.broadcast(starts), "_part")  # one row per partition
    return indexed.select((F.col("_place") + F.col("_shift")).alias(name), *ranged.columns)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``: a sample to look at."""
    return df.orderBy(*order).limit(n)
