"""Numbered versions of a table: written beside the old one, in force once the writer's end marker is there.

``<table>/version=<n>`` is a folder that one Spark job writes.  Readers take the newest version with the marker of a finished
job, so a failed or a running write is never seen, and a reader of the old version keeps its files until the next
but one is written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def children(spark: SparkSession, path: str, name: str) -> list[str]:
    """Values of the ``name=value`` folders in ``path``."""
    folder, system = _folder(spark, path)
    found = system.listStatus(folder) if system.exists(folder) else []
    names = [x.getPath().getName() for x in found]
    return [n.removeprefix(f"{name}=") for n in names if n.startswith(f"{name}=")]


def finished(spark: SparkSession, path: str) -> bool:
    marker, system = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def path(table: str, number: int) -> str:
    return f"{table}/version={number}"


def _numbers(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(n) for n in children(spark, table, "version"))


def newest(spark: SparkSession, table: str) -> int | None:
    """The newest finished version."""
    return next((n for n in reversed(_numbers(spark, table)) if finished(spark, path(table, n))), None)


def following(spark: SparkSession, table: str) -> str:
    """Where the next version goes; unfinished ones keep their numbers."""
    return path(table, 1 + max(_numbers(spark, table), default=0))


def keep_only(spark: SparkSession, folder: str, name: str, values: Iterable[str]) -> None:
    """Delete the other ``name=value`` folders."""
    for value in set(children(spark, folder, name)) - set(values):
        remove(spark, f"{folder}/{name}={value}")
