"""Jaccard join on word shingles: size-banded tiles, bitmap bounds, exact verification.

A text becomes the sorted array of hashes of its distinct runs of five words.  Two sets can reach the threshold
only if they share one of the first ``n - ceil(t * n) + 1`` hashes of each (any fixed order of all hashes will do;
here those in many prefixes come last).  Rows of one shared hash form a tile, in order of set size, so
only sets of compatible sizes meet.

* Small tiles give all their compatible pairs.
* A hash in many sets gives each of its sets one pair with the smallest id of its size band, and is looked at
  again when the links known by then have been united: only pairs of different components can matter, so a
  group of near copies costs one pair per member.  Those tiles are cut by size band and into blocks, and
  bit counts of hashed bitmaps (a bit set in one signature alone stands for at least one shingle in that
  set alone) bound the overlap from above before a pair leaves the tile.
* Every pair that is left is verified on the whole sorted arrays.

Equal sets are one set from the start.  Results for odd input: a text without words (null, empty, white space) has
an empty set and no links; a text of fewer than five words is one shingle; repeated rows are repeated in the
result; rows with a null key get no component; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.components import components
from rubrica.llm.scratch import dropped, having, stored
from rubrica.llm.textblocks import (
    LOWER,
    NOT_SPACE,
    join_hashes,
    mix,
    range_hashes,
    range_sums,
    text_blocks,
    word_bounds,
)

SHINGLE = 5
PERCENT = 80
#: Sets of a tile whose pairs are all listed; beyond, the tile is looked at again after uniting.
SMALL_TILE = 64
#: A hash counts as frequent when more prefixes hold it than this, and than this share of the documents.
FREQUENT, FREQUENT_SHARE = 25, 1 / 2000
SALTS = 32
BLOCK = 2048
#: Bits of the smallest bitmap; a larger set has two to four bits per shingle.
BITS = 1024


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """The sorted hashes of the distinct shingles of each text."""
    for low, high, raw, bounds in text_blocks(texts):
        data = LOWER[raw]
        starts, ends, first = word_bounds(data, bounds, NOT_SPACE)
        words = range_hashes(range_sums(data), starts, ends)
        runs = join_hashes(words, size)
        for row in range(high - low):
            f, n = int(first[row]), int(first[row + 1])
            if n - f >= size:
                yield np.unique(runs[f : n - size + 1])
            elif n > f:
                yield join_hashes(words[f:n], n - f)
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _compatible(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _frequent_hashes(texts: DataFrame, n_docs: int, size: int, percent: int) -> np.ndarray:
    """Hashes that many prefixes hold: fewer than 2000 times the mean prefix, whatever the corpus."""

    def prefixes(batches):
        for batch in batches:
            found = [s[: prefix_size(len(s), percent)] for s in shingle_sets(batch.column("text"), size)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    least = max(FREQUENT, int(n_docs * FREQUENT_SHARE))
    rows = (
        texts.select("text")
        .mapInArrow(prefixes, "h bigint")
        .groupBy("h")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > least)
        .select("h")
        .toArrow()
    )
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _summaries(texts: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def summarise(batches):
        hot = shared.value
        for batch in batches:
            n, one, two, prefix, tail = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                p = prefix_size(len(s), percent)
                own = _member(s[:p], hot)
                head = s[:p]
                if own.any():
                    own = _member(s, hot)
                    head = np.concatenate((s[~own], s[own]))[:p]
                    own = _member(head, hot)
                n.append(len(s))
                total = mix(s)
                one.append(int(np.bitwise_xor.reduce(total, initial=np.uint64(0)).view(np.int64)))
                two.append(int(np.add.reduce(mix(total), initial=np.uint64(0)).view(np.int64)))
                prefix.append(head.tobytes())
                tail.append(int(own.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(n, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(prefix, pa.binary()),
                    pa.array(tail, pa.int32()),
                ],
                names=["key", "n", "one", "two", "prefix", "n_frequent"],
            )

    kind = dict(texts.dtypes)["key"]
    return texts.mapInArrow(
        summarise, f"key {kind}, n bigint, one bigint, two bigint, prefix binary, n_frequent int"
    )


def _entries(batches):
    """A row per prefix hash; frequent ones are salted by key, as they are only paired with a leader."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        h = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        count = np.array([len(x) for x in h], np.int64)
        if not count.sum():
            continue
        tail = batch.column("n_frequent").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        salt = (mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(h)),
                pa.array(keys[row]),
                pa.array(batch.column("n").to_numpy(zero_copy_only=False)[row]),
                pa.array(np.where(nth >= (count - tail)[row], salt[row], 0).astype(np.int32)),
            ],
            names=["h", "key", "n", "salt"],
        )


def _runs(batches, columns: tuple[str, ...], same: int):
    """Consecutive rows with equal first ``same`` columns, as arrays; a run may come in parts."""
    rest = None
    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if not len(part[0]):
            continue
        turn = np.zeros(len(part[0]) - 1, dtype=bool)
        for x in part[:same]:
            turn |= x[1:] != x[:-1]
        cuts = np.flatnonzero(turn) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield [x[:last] for x in part], np.concatenate(([0], cuts[:-1])), cuts
        rest = [x[last:] for x in part]
    if rest is not None and len(rest[0]):
        yield rest, np.array([0]), np.array([len(rest[0])])


def _tiles(percent: int):
    """Pairs of small tiles; of large ones a pair with the leader per size band, and their rows."""

    def first_pass(batches):
        for (h, salt, n, key), low, high in _runs(batches, ("h", "salt", "n", "key"), 2):
            pairs, again = [], []
            size = high - low
            some = size >= 2
            frequent = salt[low] > 0
            small = some & ~frequent & (size <= SMALL_TILE)
            for gap in range(1, int(size[small].max()) if small.any() else 0):
                wide = small & (size > gap)
                first = np.concatenate([np.arange(s, e - gap) for s, e in zip(low[wide], high[wide], strict=True)])
                fits = _compatible(n[first], n[first + gap], percent)
                pairs.append((key[first[fits]], key[first[fits] + gap]))
            for s, e in zip(low[~small & (some | frequent)], high[~small & (some | frequent)], strict=True):
                again.append((h[s:e], key[s:e], n[s:e]))
                at = s
                while at < e:
                    end = at + int(np.searchsorted(n[at:e], n[at] * 100 // percent, "right"))
                    leader = at + int(np.argmin(key[at:end]))
                    pairs.append((key[at:end], np.full(end - at, key[leader])))
                    at = end
            if not pairs and not again:
                continue
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
            least, most = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((most, least))
            least, most = least[order], most[order]
            new = least != most
            new[1:] &= (least[1:] != least[:-1]) | (most[1:] != most[:-1])
            least, most = least[new], most[new]
            none = len(least)
            rows = [np.concatenate(x) for x in zip(*again, strict=True)] if again else [np.zeros(0, np.int64)] * 3
            total = none + len(rows[0])
            large = np.arange(total) >= none
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((least, rows[1]))),
                    pa.array(np.concatenate((most, np.zeros(len(rows[0]), np.int64))), mask=large),
                    pa.array(np.concatenate((np.zeros(none, np.int64), rows[0])), mask=~large),
                    pa.array(np.concatenate((np.zeros(none, np.int64), rows[2])), mask=~large),
                ],
                names=["a", "b", "h", "n"],
            )

    return first_pass


def _bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """Set size and bitmap of each text."""

    def encode(batches):
        for batch in batches:
            n, maps = [], []
            for s in shingle_sets(batch.column("text"), size):
                width = max(BITS, 1 << (2 * len(s)).bit_length())
                bits = np.zeros(width, np.uint8)
                bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
                n.append(len(s))
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(maps, pa.binary())],
                names=["key", "n", "bitmap"],
            )

    return stored(texts.mapInArrow(encode, "key bigint, n bigint, bitmap binary"), "bitmaps")


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """The bitmap in ``size`` bytes, as if it had been made that wide."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def _overlaps(n: np.ndarray, m: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can reach the threshold.

    A bit set in one bitmap alone stands for at least one shingle that the other set lacks.
    """
    less = np.bitwise_count(one & ~two).sum(1, dtype=np.int64)
    more = np.bitwise_count(two & ~one).sum(1, dtype=np.int64)
    most = np.minimum(n - less, m - more)
    return 100 * most >= percent * (n + m - most)


def _possible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmaps do not rule out."""

    def bound(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            widths = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
            keep = np.zeros(len(n), dtype=bool)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for at in range(0, len(own), 1024):
                    rows = own[at : at + 1024]
                    maps = (np.stack([_folded(side[i], width) for i in rows]) for side in (x, y))
                    keep[rows] = _overlaps(n[rows], m[rows], *maps, percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    return (
        pairs.join(bitmaps.select(F.col("key").alias("a"), "n", F.col("bitmap").alias("x")), "a")
        .join(bitmaps.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y")), "b")
        .select("a", "b", "n", "m", "x", "y")
        .mapInArrow(bound, "a bigint, b bigint")
    )


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sorted arrays reach the threshold.

    Texts are moved rather than arrays: they are half as large.
    """

    def intersect(batches):
        for batch in batches:
            keep = []
            sets = (shingle_sets(batch.column(c), size) for c in ("x", "y"))
            for one, two in zip(*sets, strict=True):
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    return (
        pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
        .join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(intersect, "a bigint, b bigint")
    )


def _bounded(percent: int):
    """Pairs of a tile from different components that the bitmaps do not rule out."""

    def second_pass(batches):
        columns = ("h", "band", "x", "y", "side", "home", "key", "n", "component", "bitmap")
        for rows, low, high in _runs(batches, columns, 4):
            out_a, out_b = [], []
            for s, e in zip(low.tolist(), high.tolist(), strict=True):
                side, home, key, n, part = (rows[k][s:e] for k in (4, 5, 6, 7, 8))
                width = min(map(len, rows[9][s:e]))
                maps = np.stack([_folded(x, width) for x in rows[9][s:e]])
                within = rows[2][s] == rows[3][s]
                for at in range(0, e - s, 64):
                    i = np.arange(at, min(at + 64, e - s))
                    fits = _compatible(n[i][:, None], n[None, :], percent) & (part[i][:, None] != part[None, :])
                    fits &= home[i][:, None] & (~home[None, :] | (key[i][:, None] < key[None, :]))
                    if not within:
                        fits &= side[i][:, None] != side[None, :]
                    p, q = np.nonzero(fits)
                    step = max(1, (1 << 23) // width)
                    for c in range(0, len(p), step):
                        one, two = i[p[c : c + step]], q[c : c + step]
                        left = _overlaps(n[one], n[two], maps[one], maps[two], percent)
                        out_a.append(np.minimum(key[one[left]], key[two[left]]))
                        out_b.append(np.maximum(key[one[left]], key[two[left]]))
            if out_a:
                pairs = np.unique(np.stack((np.concatenate(out_a), np.concatenate(out_b))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return second_pass


def _across(large: DataFrame, united: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Candidates of the large tiles between components that are still apart."""
    rows = (
        large.join(united.select(F.col("id").alias("key"), "component"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    mixed = rows.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.where(F.col("low") != F.col("high")).select("h")
    band = F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")
    banded = (
        rows.join(mixed, "h", "left_semi")
        .withColumn("band", F.explode(F.array(band, band + 1)))
        .withColumn("home", F.col("band") == band)
    )
    blocks = banded.groupBy("h", "band").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.max("home").alias("any_home"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    blocks = blocks.where("any_home and low <> high").select("h", "band", "blocks")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    tiles = (
        banded.join(blocks, ["h", "band"])
        .withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("side", "other"))
        .withColumn("y", F.greatest("side", "other"))
        .join(bitmaps.select("key", "bitmap"), "key")
        .repartition("h", "band", "x", "y")
        .sortWithinPartitions("h", "band", "x", "y", "key")
    )
    columns = ["h", "band", "x", "y", "side", "home", "key", "n", "component", "bitmap"]
    return tiles.select(*columns).mapInArrow(_bounded(percent), "a bigint, b bigint").distinct()


def join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Per document: ``key`` (an integer), n_shingles and component_id, the smallest linked key."""
    texts = docs.select(
        F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")
    )
    frequent = _frequent_hashes(texts, texts.count(), size, percent)
    spark = docs.sparkSession
    identity = ["n", "one", "two"]
    whole = stored(_summaries(texts, frequent, size, percent), "shingle-sets")
    sets = stored(whole.select("key", *identity), "shingle-counts")
    first = sets.where("n > 0 and key is not null").groupBy(*identity).agg(F.min("key").alias("first"))

    copies = sets.select("key", *identity).join(first, identity).where("key <> first").select("key").distinct()
    kept = whole.where("n > 0 and key is not null").join(copies, "key", "left_anti")
    entries = kept.select("key", "n", "prefix", "n_frequent").mapInArrow(
        _entries, "h bigint, key bigint, n bigint, salt int"
    )
    tiled = stored(
        entries.repartition("h", "salt")
        .sortWithinPartitions("h", "salt", "n", "key")
        .select("h", "salt", "n", "key")
        .mapInArrow(_tiles(percent), "a bigint, b bigint, h bigint, n bigint"),
        "tiles",
    )
    dropped(spark, whole)  # its prefixes are the bulk of what is stored
    pairs = stored(tiled.where("b is not null").select("a", "b").distinct(), "pairs")
    large = stored(tiled.where("b is null").select("h", F.col("a").alias("key"), "n"), "large-tiles")
    dropped(spark, tiled)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(large.select("key")).distinct()
    wanted = stored(wanted, "wanted")
    candidates = stored(having(texts, wanted, "key"), "candidates")
    dropped(spark, wanted)
    bitmaps = _bitmaps(candidates, size)

    # One pair per document unites most groups; then only pairs between groups can matter.
    one_each = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_verified(_possible(one_each, bitmaps, percent), candidates, size, percent), "shingle-links")
    united = stored(components(links), "united")
    group_of = united.select("id", "component")
    apart = (
        pairs.join(group_of.select(F.col("id").alias("a"), F.col("component").alias("of_a")), "a", "left")
        .join(group_of.select(F.col("id").alias("b"), F.col("component").alias("of_b")), "b", "left")
        .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        .select("a", "b")
    )
    rest = _possible(apart, bitmaps, percent)
    if not large.isEmpty():
        rest = rest.union(_across(large, united, bitmaps, percent)).distinct()
    rest = stored(rest, "pairs")
    dropped(spark, pairs, large, bitmaps)
    more = stored(_verified(rest, candidates, size, percent), "shingle-links")
    dropped(spark, rest, candidates)
    if not more.isEmpty():
        united = components(united.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    class_of = first.join(united.withColumnRenamed("id", "first"), "first", "left").select(
        *identity, F.coalesce("component", "first").alias("class")
    )
    return sets.join(class_of, identity, "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNotNull(), F.coalesce("class", "key")).alias("component_id"),
    )


def keep_first(docs: DataFrame, joined: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest key, and that once.

    Rows without a key are in no group and stay.
    """
    ids = joined.where(F.col(key).isNotNull())
    gone = ids.where(F.col("component_id") != F.col(key)).select(F.col(key).alias("gone")).distinct()
    kept = docs.join(gone, docs[key] == gone["gone"], "left_anti")
    total = ids.agg(F.count(key), F.count_distinct(key)).first()
    if total[0] == total[1]:
        return kept
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).union(kept.where(F.col(key).isNull()))


def oracle_sql(size: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same result by counting the shared shingles of all documents that share any."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (
        "with recursive texts as (select doc_id, regexp_extract_all("
        f"translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents), "
        "shingles as (select distinct doc_id, unnest(case "
        f"when len(w) >= {size} then [array_to_string(w[i:i + {size - 1}], ' ') for i in range(1, len(w) - {size - 2})] "
        "when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from texts), "
        "sizes as (select doc_id, count(*) as n from shingles group by doc_id), "
        "shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b "
        "on a.s = b.s and a.doc_id < b.doc_id group by all), "
        "near as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b "
        f"where 100 * common >= {percent} * (x.n + y.n - common)), "
        "links as (select a, b from near union all select b, a from near), "
        "reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a), "
        "lowest as (select a, min(b) as low from reach group by a) "
        "select t.doc_id, coalesce(n, 0) as n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) as component_id "
        "from texts t left join sizes z on z.doc_id = t.doc_id left join lowest l on l.a = t.doc_id"
    )
