"""Input tables for the registered queries, derived from the given Parquet tables.

Every derivation runs over whole tables and whole texts: each sentence of each document becomes
one item of an answer sheet, each order one rated answer, each vector one model output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.binding import bind
from rubrica.functions.text import clean_text


# Stored bytes that a task of heavy work per row should get; row groups may be much larger, or a whole table.
TASK_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of a table for heavy work per row, spread over all task slots and over as many
    tasks as its bytes ask for: a task does not grow with the table or its row groups."""
    rows = table(spark, sf_dir, name).select(*columns)
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    size = files.agg(F.sum("length")).first()[0] or 0
    return rows.repartition(max(4 * slots, -(-size // TASK_BYTES)), key)


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per document, one item per sentence, the answer being one of eight variants:
    exact, noisy, gibberish, cut short, restarted, cut shorter, another sentence, blank."""
    docs = spread_table(spark, sf_dir, "documents", "doc_id", ["doc_id", "lang", "source", "text"])

    def with_next(sentences: Column) -> Column:
        return F.transform(
            sentences,
            lambda x, i: F.struct(i.alias("pos"), x.alias("sent"), F.get(sentences, i + 1).alias("other")),
        )

    sentences = bind(F.split("text", r"[.!?\n]+", -1), with_next)
    items = docs.select("doc_id", "lang", "source", F.inline(sentences)).select(
        "*",
        F.length("sent").alias("len"),
        F.pmod(F.col("doc_id") + F.col("pos"), F.lit(8)).alias("v"),
    )
    v, sent, length = F.col("v"), F.col("sent"), F.col("len")

    def start(tenths: int) -> Column:
        return F.expr(f"substr(sent, 1, cast(len * {tenths} div 10 as int))")

    answer = (
        F.when(v == 0, sent)
        .when(v == 1, F.concat(F.lit("[cough] "), sent, F.lit("!")))
        .when(v == 2, "[pause] xxx")
        .when(v == 3, start(7))
        .when(v == 4, F.concat(F.lit("dis- "), sent))
        .when(v == 5, start(3))
        .when(v == 6, F.col("other"))
        .otherwise("   ")
    )
    score = (
        F.when(v.isin(0, 4), "4")
        .when(v == 1, "4.0")
        .when(v == 2, "0")
        .when((v == 3) & (length % 5 == 0), "7")
        .when((v == 3) & (length % 5 == 1), "3\t")
        .when((v == 3) & (length % 5 == 2), "\n3")
        .when((v == 3) & (length % 5 == 3), "\u00a03")
        .when(v == 3, " 3 ")
        .when((v == 5) & (length % 7 == 0), "n/a")
        .when(v == 5, "1.9")
        .when(v == 6, "2")
    )
    kind = (
        F.when(F.col("source") == "src7", "Answer Key ")
        .when(F.col("source") == "src13", "Info ")
        .otherwise("Participant ")
    )
    return items.select(
        F.lit(0).alias("sheet_ordinal"),
        F.concat(kind, F.col("doc_id"), F.lit("_"), F.col("lang")).alias("sheet_name"),
        F.col("pos").cast("long").alias("row_ordinal"),
        F.concat(sent, F.lit(" ("), length, F.lit(")")).alias("stimulus"),
        answer.alias("transcription"),
        score.alias("human_score"),
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn but the assistant's with the assistant turn that follows (empty if none does), both cleaned.

    An equality join on (conversation, turn), so a long conversation is spread over tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") != "assistant").select("conv_id", "turn", F.col("text").alias("stimulus"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        clean_text(F.col("stimulus")).alias("clean_stimulus"),
        clean_text(F.col("response")).alias("clean_response"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one numbered next, the last one without."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return vectors.select("vec_id", F.col("embedding").alias("a")).join(following, "vec_id", "left")


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as model outputs, each of sums over all values: three logits, four cumulative
    probabilities, one score."""
    v = F.col("embedding")

    def total(parts: int, part: int) -> Column:
        own = F.filter(v, lambda _, i: i % parts == part)
        return F.aggregate(own, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double"))

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.array(*[total(3, k) * 2.0 for k in range(3)]).alias("logits"),
        *[((total(4, k) + 1.0) / 2.0).alias(f"g{k}") for k in range(4)],
        total(1, 0).alias("score"),
    )


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as rated answers: label ``y`` from the priority, a noisy 4-decimal ``raw``."""
    orders = table(spark, sf_dir, "orders")
    y = F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")
    raw = F.lit(0.15) * F.col("y") + F.lit(0.4) * F.col("price") / F.lit(500000.0)
    return orders.select(
        F.col("o_orderkey").alias("id"), y.alias("y"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
    ).select(
        "id", "y", "status",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(raw * 10000 + 0.5) / 10000)).alias("raw"),
    )


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated answers with features computed from their score, a third of the end classes settled
    by the gate and therefore without features."""
    y, raw, h, ent = F.col("y"), F.col("raw"), F.col("h"), F.col("ent")

    def four(x: Column) -> Column:
        return F.floor(x * 10000 + 0.5) / 10000

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    third = F.col("id") % 3 == 0
    gate = F.when(third & (y == 4), 4).when(third & (y == 0), 0)
    base = (
        rated(spark, sf_dir)
        .withColumns({"h": (F.col("id") * 7919 % 1000).cast("double") / 1000, "early_gate_score": gate})
        .withColumn("ent", four(unit(raw + F.lit(0.2) * (h - 0.5))))
        .withColumn("con", four((F.lit(1.0) - ent) * 0.6))
    )
    is_open = F.col("early_gate_score").isNull()
    features = {
        "nli_margin": four(ent - F.col("con")),
        "nli_entailment": ent,
        "nli_contradiction": F.col("con"),
        "sbert_similarity": four(F.least(F.lit(1.0), F.lit(0.9) * raw + F.lit(0.1) * h)),
        "lemma_recall": F.floor(raw * 100 + 0.5) / 100,
    }
    return base.select(
        "id",
        y.alias("human_score"),
        "early_gate_score",
        *[F.when(is_open, value).alias(name) for name, value in features.items()],
    )


def lexicon(cleaned: DataFrame) -> DataFrame:
    """A lexicon made from the words of cleaned pairs: plural endings off, short words are stop
    words, words of even length are nouns."""
    words = cleaned.select(F.explode(F.array("clean_stimulus", "clean_response")).alias("text"))
    form = F.col("form")
    return (
        words.select(F.explode(F.split("text", " ")).alias("form"))
        .filter(form != "")
        .distinct()
        .select(
            "form",
            F.regexp_replace(form, "(es|s)$", "").alias("lemma"),
            F.when(F.length(form) % 2 == 0, "NOUN").otherwise("X").alias("pos"),
            (F.length(form) <= 3).alias("is_stop"),
        )
    )
