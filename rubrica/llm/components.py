"""Connected components of links that are never gathered in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.scratch import dropped, stored

#: Links that one task unites.
TASK_LINKS = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that have a smaller one in reach, and the smallest one."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], low)
        np.minimum.at(new, label[two], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _united(batches):
    """The links of a task as stars around the smallest ids."""
    parts = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches]
    if parts:
        u, v = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id (an integer) that has a link: the smallest id reachable.

    Each round deals the links to tasks by their number, and every task unites its own.  If there was
    more than one task, alternating large and small stars follow: they link every neighbour to the smallest one, first
    upwards, then downwards, and after a logarithmic number of rounds only stars are left.  The minimum of
    a neighbourhood is aggregated before the shuffle; the driver gets a count and a checksum.
    """
    spark = links.sparkSession
    u, v = F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")
    edges = stored(links.where(F.col(a) != F.col(b)).select(u, v), "links")
    state = None
    while True:
        following = _state(edges)
        if following == state or not following[0]:
            break
        state, tasks = following, -(-following[0] // TASK_LINKS)
        dealt = edges.repartition(tasks, "v") if tasks > 1 else edges.repartition(1)
        united = stored(dealt.mapInArrow(_united, "u bigint, v bigint"), "united")
        dropped(spark, edges)
        edges = united
        if tasks == 1:
            break
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        dropped(spark, united, large)
    smallest = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(smallest)
