"""Exact duplicates through an extendible-hash index in the shared folder, with DataFrame functions alone.

Every row enters with a 64-bit hash of its normalised text (the key), the text's SHA-256 and its id; copies are
pre-aggregated, so the index holds one entry per distinct key and digest, whatever the size of a group.  The directory starts
as one bucket.  Buckets with more than ``capacity`` keys are split by their next key bit, and the directory doubles whenever a
bucket is split at its full depth; eight doublings are done per count of the keys, only keys of overfull buckets are counted
again.  Entries are written in bucket order: a task owns a range of buckets, hence of keys, and numbers the
entries of a key as its chain.  The texts of keys that stand for more than one row then meet there and are compared byte
by byte (grouping by key, digest and the text itself, combined within tasks first); only these texts are moved.  Rows find their
group by key and digest.  Two texts that agree in both but differ in bytes stop the run with an error; no such pair
is known for SHA-256.

Of equal texts the row with the largest id stays.  Results for odd input: a null text is empty; rows that repeat id and
text are one document and marked alike; a null id stays only in a group without other ids (``keep_id`` null); a text of any
length is one value; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.llm.scratch import dropped, stored
from rubrica.operators.lookup import fits_broadcast, lookup_join

#: Keys per bucket, and key bits by which overfull buckets may grow per count.
CAPACITY = 4096
STEP = 8
#: Directory slots (two numbers each) that may be sent to every task.
BROADCAST_SLOTS = 1 << 20


def unchanged(text: Column) -> Column:
    return text


@dataclass(frozen=True)
class Index:
    """Stored tables of one run, and the directory's depth in bits."""

    entries: DataFrame  #: doc_id, key, digest of every row
    directory: DataFrame  #: slot, bucket, depth
    buckets: DataFrame  #: bucket, depth, key, digest, n, keep_id, place in the chain, chain length
    depth: int


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("bigint")


def _summed(counts: str, level: int) -> Column:
    """Keys of each of the 2**level buckets that 2**STEP slots form at a depth."""
    width = 1 << (STEP - level)

    def bucket(p: Column) -> Column:
        own = F.slice(counts, p * width + 1, F.lit(width))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, n: total + n)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << level) - 1)), bucket)


def _directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) over all slots, and the number of bits of a slot."""
    bits, closed, open_ones = 0, None, None
    while True:
        among = keys.select(_prefix(F.col("key"), bits).alias("prefix"), _prefix(F.col("key"), bits + STEP).alias("slot"))
        if bits:
            few = fits_broadcast(open_ones)
            among = among.join(F.broadcast(open_ones) if few else open_ones, "prefix", "left_semi")
        counted = among.groupBy("prefix", "slot").agg(F.count("*").alias("n"))
        slots = F.map_from_entries(F.collect_list(F.struct((F.col("slot") % (1 << STEP)).cast("int"), "n")))
        if bits:  # 2**STEP entries per prefix at most
            found = open_ones.join(counted.groupBy("prefix").agg(slots.alias("found")), "prefix", "left")
        else:
            found = counted.agg(F.lit(0).cast("bigint").alias("prefix"), slots.alias("found"))
        filled = found.select(
            "prefix",
            F.transform(
                F.sequence(F.lit(0), F.lit((1 << STEP) - 1)),
                lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("bigint")),
            ).alias("counts"),
        )
        levels = range(0 if not bits else 1, STEP + 1)
        sums = [_summed("counts", level).alias(f"sums{level}") for level in levels]
        depth = F.coalesce(
            *(
                F.when(F.get(f"sums{level}", F.shiftright("i", STEP - level)) <= capacity, F.lit(level))
                for level in levels
            )
        )
        split = (
            filled.select("prefix", *sums)
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit((1 << STEP) - 1))))
            .select((F.col("prefix") * (1 << STEP) + F.col("i")).alias("slot"), depth.alias("level"))
        )
        split = stored(split, "directory-round")
        done = split.where("level is not null").select(
            F.expr(f"shiftrightunsigned(slot, {STEP} - level)").alias("prefix"), (F.col("level") + bits).alias("depth")
        )
        closed = done.distinct() if closed is None else closed.unionByName(done.distinct())
        open_ones = split.where("level is null").select(F.col("slot").alias("prefix"))
        bits += STEP
        if open_ones.isEmpty():
            break
    deepest = closed.agg(F.max("depth")).first()[0]
    first = F.expr(f"shiftleft(prefix, {deepest} - depth)")
    last = first + F.expr(f"shiftleft(1L, {deepest} - depth)") - 1
    slots = closed.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "depth")
    return stored(slots, "directory"), deepest


def build(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = unchanged,
    capacity: int = CAPACITY,
    key_bits: int = 64,
) -> Index:
    """The index of a table.  ``key_bits`` under 64 makes keys collide, to try the chains."""
    spark = docs.sparkSession
    entries = stored(_keyed(docs, key, text, normalise, key_bits).drop("text"), "entries")
    summary = entries.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    summary = stored(summary, "distinct-entries")
    directory, depth = _directory(summary.select("key").distinct(), capacity)
    few = (1 << depth) <= BROADCAST_SLOTS
    dealt = summary.withColumn("slot", _prefix(F.col("key"), depth)).join(
        F.broadcast(directory) if few else directory, "slot"
    )
    chain = Window.partitionBy("bucket", "key")
    owned = dealt.repartitionByRange("bucket").select(
        "bucket",
        "depth",
        "key",
        "digest",
        "n",
        "keep_id",
        F.row_number().over(chain.orderBy("digest")).alias("place"),
        F.count("*").over(chain).alias("chain"),
    )
    buckets = stored(owned.sortWithinPartitions("bucket", "key", "place"), "buckets")
    dropped(spark, summary)
    return Index(entries, directory, buckets, depth)


def _keyed(docs: DataFrame, key: str, text: str, normalise, key_bits: int) -> DataFrame:
    plain = docs.select(
        F.col(key).alias("doc_id"), normalise(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")
    )
    hashed = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits), 64 - key_bits)
    return plain.select("doc_id", "text", hashed.alias("key"), F.unhex(F.sha2("text", 256)).alias("digest"))


def compared(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text", normalise=unchanged, key_bits=64):
    """(key, digest, keep_id, group_size) of every group of several rows, after comparing all bytes of their texts."""
    several = index.buckets.where("n > 1 or chain > 1").select("key").distinct()
    several = stored(several, "chained")
    rows = _keyed(docs, key, text, normalise, key_bits)
    if fits_broadcast(several):  # else every distinct text is compared: the same groups
        rows = rows.join(F.broadcast(several), "key", "left_semi")
    texts = rows.groupBy("key", "digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    groups = texts.groupBy("key", "digest").agg(
        F.count("*").alias("texts"), F.sum("n").alias("group_size"), F.max("keep_id").alias("keep_id")
    )
    differ = F.raise_error(F.lit("two different texts share a key and a SHA-256 digest"))
    size = F.when(F.col("texts") > 1, differ.cast("bigint")).otherwise(F.col("group_size"))
    groups = groups.select("key", "digest", "keep_id", size.alias("group_size"))
    return stored(groups.where("group_size > 1"), "groups")


def resolve(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = unchanged,
    capacity: int = CAPACITY,
    key_bits: int = 64,
) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build(docs, key, text, normalise, capacity, key_bits)
    groups = compared(docs, index, key, text, normalise, key_bits)
    found = lookup_join(index.entries, groups, ["key", "digest"], ["doc_id"])
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    stay = decisions.where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, key, "left_semi")


def oracle_sql() -> str:
    return """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
