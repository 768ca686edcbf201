"""Steps whose tasks and passes must not grow with the tables."""

from pyspark.sql import functions as F

from rubrica.config import GIBBERISH_MARKERS, NOISE_TAGS, CleanConfig
from rubrica.functions import text
from rubrica.operators import features, lookup
from rubrica.plans import fixtures


def test_a_large_table_is_spread_by_its_bytes(spark, tmp_path, monkeypatch):
    """One row group, more bytes than the slots' share: read as it is, it would be one task."""
    folder = f"{tmp_path}/documents.parquet"
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(folder)
    size = spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()[0]
    slots = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "TASK_BYTES", size // (16 * slots))
    spread = fixtures.spread_table(spark, str(tmp_path), "documents", "doc_id", ["doc_id", "text"])
    assert spread.rdd.getNumPartitions() >= 16 * slots
    assert sorted(spread.collect()) == sorted(rows.collect())


def test_an_empty_table_is_spread_too(spark, tmp_path):
    spark.range(0).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    assert fixtures.spread_table(spark, str(tmp_path), "documents", "doc_id", ["doc_id"]).count() == 0


def _large_lookup(spark):
    """Ten keys with nine tenths of the rows, rare ones, unknown ones and nulls."""
    n = F.col("id")
    key = F.when(n % 10 != 0, F.concat(F.lit("common"), n % 10)).when(n % 50 != 0, F.concat(F.lit("rare"), n))
    big = spark.range(20_000).select(n.alias("row"), key.alias("k"))
    known = spark.range(15_000).select(F.concat(F.lit("rare"), "id").alias("k"), F.col("id").alias("v"))
    return big, known.unionByName(spark.createDataFrame([(f"common{i}", -i) for i in range(8)], "k string, v long"))


def test_frequent_keys_are_not_shuffled(spark):
    big, small = _large_lookup(spark)
    want = {r.row: (r.k, r.v) for r in big.join(small, "k", "left").collect()}
    joined = lookup.lookup_join(big, small, ["k"], ["row"], small_fits=False)
    got = joined.collect()
    assert len(got) == 20_000 and {r.row: (r.k, r.v) for r in got} == want
    counts = big.groupBy("k").agg(F.count("*").alias("_n"))
    frequent = lookup._frequent(counts, small, ["k"])
    assert {f"common{i}" for i in range(1, 10)} <= {r.k for r in frequent.collect()}


def test_keys_that_are_all_rare_take_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT_KEYS", 5)
    big, small = _large_lookup(spark)
    counts = big.groupBy("k").agg(F.count("*").alias("_n"))
    assert lookup._frequent(counts, small, ["k"]) is None
    empty = big.limit(0)
    assert lookup.lookup_join(empty, small, ["k"], ["row"], small_fits=False).collect() == []


def test_similarity_is_stored_before_it_is_measured_and_joined(spark, monkeypatch):
    kept = []
    store = features.materialize
    monkeypatch.setattr(features, "materialize", lambda df, name: kept.append(name) or store(df, name))
    pairs = spark.createDataFrame([("a b", "a c"), ("a b", "d"), ("e", "e")], ", ".join(f"{c} string" for c in features.PAIR))
    rows = features.vector_similarity(pairs, features.hashed_embedder()).collect()
    assert kept.count("similarity") == 1
    assert {(r.clean_stimulus, r.clean_response): r.sbert_similarity for r in rows}[("a b", "a c")] == 0.5


def test_vectors_of_hashed_words_are_not_moved(spark, monkeypatch):
    kept = []
    store = features.materialize
    monkeypatch.setattr(features, "materialize", lambda df, name: kept.append(name) or store(df, name))
    texts = ["a b", "a c c", "d", "a b d e", ""]
    pairs = spark.createDataFrame([(x, y) for x in texts for y in texts], ", ".join(f"{c} string" for c in features.PAIR))
    embedder = features.hashed_embedder()
    beside = features.vector_similarity(pairs, embedder).collect()
    assert "vectors" not in kept
    joined = features.vector_similarity(pairs, lambda texts: embedder(texts)).collect()
    assert "vectors" in kept and sorted(beside) == sorted(joined) and len(beside) == len(texts) ** 2


def test_noise_is_looked_for_only_where_its_first_characters_are(spark):
    texts = ["hola", "[pause] hola", "Xxx hola", "xxx", "m- muy", "a[b", "", "x", "[EN INGL\u00c9S] y", "\u017f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    straight = text.remove_restarts(text.remove_gibberish(text.remove_noise_tags(F.lower(t), NOISE_TAGS), GIBBERISH_MARKERS))
    for words in ((*NOISE_TAGS, *GIBBERISH_MARKERS, "-"), ("kilo", "-"), ("\u00e9", "-"), ("-",)):
        may = text._may_hold(F.lower(t), words)
        for r in rows.select(t, may.alias("may"), straight.alias("out")).collect():
            assert r.may or not any(w in r.t.lower() for w in words)
            assert r.may or r.out == r.t.lower() or words[0] in ("kilo", "\u00e9", "-")
    plain = CleanConfig(noise_tags=(), gibberish_markers=("sigma",), remove_punctuation=False, normalize_accents=False)
    got = spark.createDataFrame([("sigma a",), ("\u017figma a",)], "t string").select(text.clean_text(t, plain).alias("x"))
    assert [r.x for r in got.collect()] == ["a", "a"]
