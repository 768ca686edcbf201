"""A cached table that follows its source files: a manifest per version, only changed files read again.

Layout: ``manifest/version=<n>`` lists the source files (unit, path, size, time) with the refresh that holds their rows, and
``<kind>/refresh=<id>`` holds the rows of one kind (pairs, load report) made by one refresh, in sheet order, so that the files and
row groups of a sheet are found by their statistics, however many sheets there are.  A refresh writes its rows first and the new
manifest last; a version counts once its writer has left the marker of a finished job, so readers see the old version or the new
one, never a part, and a failed write changes nothing.

Files of a folder that form one table with a sheet column are one unit, every other file is a unit of its own; a
unit is read again if one of its files changed, was added or is gone.  Rows of refreshes that neither the new version
nor the one before refers to are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.operators.lookup import fits_broadcast
from rubrica.session import materialize
from rubrica.sources import versions

SHEETS = T.StructType([T.StructField("sheet_name", T.StringType()), T.StructField("unit", T.StringType())])
MANIFEST = "unit string, path string, size bigint, time timestamp, refresh string"


@dataclass(frozen=True)
class Version:
    number: int
    manifest: DataFrame


def plain_path(path: Column) -> Column:
    """Local paths as the listing spells them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def unit() -> Column:
    """The unit of a ``path``: table parts written by Spark belong to their folder, other files stand for themselves."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return F.when(F.col("path").rlike(r"/part-[^/]*\.parquet$"), parent).otherwise(F.col("path"))


def listing(spark: SparkSession, source: str) -> DataFrame:
    """Files under ``source`` as they are now; their contents are not read."""
    try:
        files = spark.read.format("binaryFile").load(source).withColumn("path", plain_path(F.col("path")))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST).drop("refresh")
    return files.select(unit().alias("unit"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def differences(now: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are new or changed, and files that are gone."""
    same = ["path", "size", "time"]
    return now.join(kept.select(*same), same, "left_anti"), kept.join(now.select("path"), "path", "left_anti")


def current(spark: SparkSession, cache: str) -> Version | None:
    """The newest finished version."""
    number = versions.newest(spark, f"{cache}/manifest")
    if number is None:
        return None
    return Version(number, spark.read.schema(MANIFEST).parquet(versions.path(f"{cache}/manifest", number)))


def read(spark: SparkSession, cache: str, version: Version, kind: str, schema: T.StructType) -> DataFrame:
    """The rows of a version."""
    if not versions.children(spark, f"{cache}/{kind}", "refresh"):
        return spark.createDataFrame([], schema)
    own = [f for f in schema.fields if f.name != "unit"]
    every = T.StructType([*own, *(T.StructField(c, T.StringType()) for c in ("unit", "refresh"))])
    data = spark.read.schema(every).option("basePath", f"{cache}/{kind}").parquet(f"{cache}/{kind}")
    held = version.manifest.select("unit", "refresh").distinct()
    held = F.broadcast(held) if fits_broadcast(held) else held
    return data.join(held, ["unit", "refresh"], "left_semi").select(*schema.names)


def _write(folder: str, rows: DataFrame, sheets: DataFrame) -> None:
    """Rows of the units that are read again, in sheet order."""
    order = [c for c in ("sheet_name", "row_ordinal") if c in rows.columns]
    sheets = F.broadcast(sheets) if fits_broadcast(sheets) else sheets
    placed = rows.join(sheets, "sheet_name").select(*rows.columns, "unit")
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(folder)


def _check_sheets(sheets: DataFrame, others: DataFrame) -> None:
    """A sheet may come from one unit only."""
    every = sheets.unionByName(others).groupBy("sheet_name").agg(F.countDistinct("unit").alias("n"))
    twice = [r["sheet_name"] for r in every.filter("n > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"sheet names that occur in several files: {twice}")


def _forget(spark: SparkSession, cache: str, kinds: Iterable[str], last: list[Version]) -> None:
    """Delete refreshes that none of the versions refers to, and older manifests."""
    used = {r["refresh"] for v in last for r in v.manifest.select("refresh").distinct().collect()}
    numbers = {str(v.number) for v in last}
    for kind in kinds:
        versions.keep_only(spark, f"{cache}/{kind}", "refresh", used)
    versions.keep_only(spark, f"{cache}/manifest", "version", numbers)


def refreshed(
    spark: SparkSession,
    source: str,
    cache: str,
    tables_of: Callable[[list[str], bool], tuple[dict[str, DataFrame], DataFrame]],
    kinds: Iterable[str],
    force: bool = False,
) -> Version:
    """The version that ``source`` has now, written if need be.

    ``tables_of`` gives the rows of some files by kind, with their ``sheet_name``, and (sheet_name, path) of their
    sheets; it is told whether rows of other files stay.
    """
    now = materialize(listing(spark, source), "listing")
    before = current(spark, cache)
    kept = before.manifest if before and not force else spark.createDataFrame([], MANIFEST)
    changed, gone = differences(now, kept)
    stale = materialize(changed.select("unit").union(gone.select("unit")).distinct(), "stale-units")
    if before and not force and stale.isEmpty():
        return before
    refresh = uuid.uuid4().hex
    again = now.join(stale, "unit", "left_semi")
    staying = materialize(kept.join(stale, "unit", "left_anti"), "kept-units")
    files = [r["path"] for r in again.select("path").collect()]  # one row per file that is read again
    if files:
        tables, sheets = tables_of(sorted(files), not staying.isEmpty())
        sheets = materialize(sheets.select("sheet_name", unit().alias("unit")).distinct(), "sheets")
        for kind, rows in tables.items():
            others = read(spark, cache, Version(0, staying), kind, SHEETS)
            _check_sheets(sheets, others.distinct())
            _write(f"{cache}/{kind}/refresh={refresh}", rows, sheets)
    manifest = staying.unionByName(again.withColumn("refresh", F.lit(refresh)))
    manifest.coalesce(1).write.parquet(versions.following(spark, f"{cache}/manifest"))
    new = current(spark, cache)
    _forget(spark, cache, kinds, [new, *([before] if before else [])])
    return new
