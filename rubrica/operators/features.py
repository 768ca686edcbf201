"""Features of unresolved pairs: lexical overlap, vector similarity, pair-model margin.

Models are functions from DataFrame to DataFrame, so a JVM expression, a Spark ML stage or a
Python model behind ``mapInPandas`` all fit the same slot.  They see each distinct pair and, unless they work row by row in the
JVM, each distinct text once; results are joined by
the 128-bit digests of the texts, so texts move once to become distinct, and never as join keys.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import FeatureConfig
from rubrica.functions import lexical
from rubrica.functions.pairs import NLI_FEATURES, joint_similarity, label_positions, nli_columns, softmax
from rubrica.functions.vectors import cosine
from rubrica.operators.lookup import fits_broadcast, lookup_join
from rubrica.session import materialize

logger = logging.getLogger(__name__)

PAIR = ["clean_stimulus", "clean_response"]

# Digests of the two texts.
PAIR_ID = ["stimulus_id", "response_id"]

# (id, text) -> (id, vector)
Embedder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PairModel:
    """``predict`` maps (pair_id, premise, hypothesis) to (pair_id, logits)."""

    predict: Callable[[DataFrame], DataFrame]
    labels: Sequence[str] = ("entailment", "neutral", "contradiction")


@dataclass(frozen=True)
class Models:
    """What the engines run on.  ``lexicon`` has ``form, lemma, pos, is_stop``, one row a form.

    ``joint_model`` maps (stimulus_id, response_id and both texts) to the ids and ``score``.
    ``stand_ins`` lets hashed and shared words stand in for models that are not given; without it
    a missing model is an error.
    """

    lexicon: DataFrame | None = None
    embedder: Embedder | None = None
    pair_model: PairModel | None = None
    joint_model: Callable[[DataFrame], DataFrame] | None = None
    stand_ins: bool = False


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_ids(df: DataFrame) -> DataFrame:
    """``df`` with the digests of its texts."""
    return df.withColumns({name: text_id(F.col(side)) for name, side in zip(PAIR_ID, PAIR)})


def _distinct_pairs(df: DataFrame) -> DataFrame:
    """Ids and texts of each distinct pair."""
    return with_ids(df.select(*PAIR)).dropDuplicates(PAIR_ID)


def _distinct_texts(pairs: DataFrame) -> DataFrame:
    """(id, text) of each distinct text; stored.  Two texts of one digest are an error."""
    sides = [F.struct(F.col(i).alias("id"), F.col(side).alias("text")) for i, side in zip(PAIR_ID, PAIR)]
    texts = materialize(pairs.select(F.inline(F.array(*sides))).distinct(), "texts")
    if not texts.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("two different texts have the same digest")
    return texts


def _both_texts() -> Column:
    return (F.col("clean_stimulus") != "") & (F.col("clean_response") != "")


# --- lexical ------------------------------------------------------------------------------


def _finish_overlap(counted: DataFrame, keep: list[str]) -> DataFrame:
    c = F.col
    columns = [
        *lexical.overlap_columns(c("_lemma_both"), c("_lemma_s"), c("_lemma_r"), "lemma"),
        *lexical.overlap_columns(c("_idea_both"), c("_idea_s"), c("_idea_r"), "idea_unit"),
        c("_lemma_s").cast("int").alias("stimulus_lemma_count"),
        c("_lemma_r").cast("int").alias("response_lemma_count"),
        c("_idea_s").cast("int").alias("stimulus_idea_count"),
        c("_idea_r").cast("int").alias("response_idea_count"),
    ]
    return counted.select(*keep, *columns).select(*keep, *lexical.LEXICAL_FEATURES)


def lexical_features(
    df: DataFrame,
    key: list[str],
    lexicon: DataFrame | None = None,
    cfg: FeatureConfig = FeatureConfig(),
    only: Column | None = None,
) -> DataFrame:
    """The eight overlap features of ``clean_stimulus`` and ``clean_response``.

    Without a lexicon a word is its own lemma, nothing is known to be a content word, and the
    operator is a projection.  With one, the words are looked up and lemmas are counted per
    row of ``key``.  Where the lexicon can be broadcast, rows are shuffled by key once, as text,
    before they are split into words, and both counts follow without another shuffle.
    Idea units follow the lexicon's part of speech, not the sentence.  Rows outside ``only``
    and rows with an empty text get zeros.
    """
    wanted = _both_texts() if only is None else only & _both_texts()
    words = {side: lexical.tokens(F.col(side), cfg.number_words) for side in PAIR}
    none = F.array().cast("array<string>")
    if lexicon is None:
        sets = df.withColumns({f"_{side}": F.when(wanted, words[side]).otherwise(none) for side in PAIR})
        stim, resp = F.col("_clean_stimulus"), F.col("_clean_response")
        sizes = {
            "_lemma_s": F.size(stim),
            "_lemma_r": F.size(resp),
            "_lemma_both": F.size(F.array_intersect(stim, resp)),
        }
        ideas = {name: F.lit(0) for name in ("_idea_s", "_idea_r", "_idea_both")}
        return _finish_overlap(sets.withColumns(sizes | ideas), df.columns)

    def tagged(forms: Column, sides: int) -> Column:
        return F.transform(forms, lambda t: F.struct(t.alias("form"), F.lit(sides).alias("sides")))

    # Unwanted rows have no words and vanish here; a filter would repeat the cleaning.
    rows = df.select(*key, *PAIR, wanted.alias("_wanted"))
    small = fits_broadcast(lexicon)
    rows = rows.repartition(*key) if small else rows
    listed = rows.select(*key, *[F.when(F.col("_wanted"), words[side]).otherwise(none).alias(f"_{side}") for side in PAIR])
    stim, resp = F.col("_clean_stimulus"), F.col("_clean_response")
    # A word of both texts is looked up and counted once: bit 1 for the stimulus, bit 2 for the response.
    every = [
        tagged(F.array_intersect(stim, resp), 3), tagged(F.array_except(stim, resp), 1), tagged(F.array_except(resp, stim), 2)
    ]
    forms = listed.select(*key, F.concat(*every).alias("_words"))
    # A lexicon that is not broadcast is looked up in several passes over the words.
    forms = forms if small else materialize(forms, "words")
    occurrences = forms.select(*key, F.inline("_words"))
    found = lookup_join(occurrences, lexicon, ["form"], spread_by=key, small_fits=small)

    listed = F.lower(F.trim(F.coalesce(F.col("lemma"), F.col("form"))))
    content = F.coalesce(F.col("pos").isin(*cfg.content_pos), F.lit(False))
    if cfg.remove_stopwords_for_ideas:
        content = content & ~F.coalesce(F.col("is_stop"), F.lit(False))
    units = found.select(
        *key,
        F.when(listed == "-pron-", F.col("form")).otherwise(listed).alias("lemma"),
        # Bits 4 and 8: the same sides, as an idea unit.
        F.when(content, F.col("sides") * 5).otherwise(F.col("sides")).alias("sides"),
    ).filter(F.col("lemma") != "")
    # One shuffle by key serves both counts; where the lexicon was broadcast the rows came in by key.
    units = units if small else units.repartition(*key)

    def holds(bits: int) -> Column:
        return F.count_if(F.col("sides").bitwiseAND(bits) == bits)

    lemmas = units.groupBy(*key, "lemma").agg(F.bit_or("sides").alias("sides"))
    counts = lemmas.groupBy(*key).agg(
        holds(1).alias("_lemma_s"),
        holds(2).alias("_lemma_r"),
        holds(3).alias("_lemma_both"),
        holds(4).alias("_idea_s"),
        holds(8).alias("_idea_r"),
        holds(12).alias("_idea_both"),
    )
    sums = [c for c in counts.columns if c not in key]
    joined = df.join(counts, key, "left").fillna(0, subset=sums)
    return _finish_overlap(joined, df.columns)


# --- vectors ------------------------------------------------------------------------------


@dataclass(frozen=True)
class RowEmbedder:
    """Unit vectors of hashed words, row by row in the JVM: an embedder of texts that also works beside other columns."""

    width: int

    def __call__(self, texts: DataFrame) -> DataFrame:
        return self.beside(texts, {"text": "vector"}).select("id", "vector")

    def beside(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """``df`` with the vectors of its text columns, under the names given for them."""
        for text, vector in names.items():
            split = df.withColumn("_words", F.split(text, " "))
            hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.width).transform(split)
            unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
            df = unit.withColumn(vector, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")
        return df


def hashed_embedder(width: int = 256) -> Embedder:
    """Deterministic unit vectors of hashed words: a stand-in that needs no model file."""
    return RowEmbedder(width)


# Rows that one task runs through a model.
MODEL_ROWS = 16_384


def model_tasks(df: DataFrame) -> DataFrame:
    """Deal rows to tasks by their number, all task slots at least: model time follows rows, not bytes.

    ``df`` should be a stored table, as it is counted first.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // MODEL_ROWS)))


def python_embedder(load: Callable[[], Callable[[list[str]], object]], batch_size: int = 8) -> Embedder:
    """Embedder from a Python model: ``load()`` runs once per task and returns a function from
    a list of texts to an array of vectors."""

    def embed_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                yield pd.DataFrame({"id": part["id"].tolist(), "vector": list(encode(part["text"].tolist()))})

    def embed(texts: DataFrame) -> DataFrame:
        return model_tasks(texts).mapInPandas(embed_batches, "id binary, vector array<float>")

    return embed


def _similarity(pairs: DataFrame, texts: DataFrame, embedder: Embedder) -> DataFrame:
    """Ids and ``sbert_similarity`` of distinct pairs, stored: both are joined or measured more than once.

    Vectors are written too, so that none is computed twice; but those of hashed words take less time to compute for
    each pair than to write, shuffle and join.
    """
    if isinstance(embedder, RowEmbedder):
        out = embedder.beside(pairs.select(*PAIR_ID, *PAIR), {side: f"_{name}" for side, name in zip(PAIR, PAIR_ID)})
    else:
        vectors = materialize(embedder(texts), "vectors")
        fits = fits_broadcast(vectors)
        out = pairs.select(*PAIR_ID)
        for name in PAIR_ID:
            named = vectors.select(F.col("id").alias(name), F.col("vector").alias(f"_{name}"))
            out = lookup_join(out, named, [name], spread_by=PAIR_ID, small_fits=fits)
    similarity = cosine(*(F.col(f"_{name}") for name in PAIR_ID))
    return materialize(out.select(*PAIR_ID, similarity.alias("sbert_similarity")), "similarity")


def vector_similarity(pairs: DataFrame, embedder: Embedder) -> DataFrame:
    """``sbert_similarity`` of distinct (stimulus, response) pairs."""
    ided = materialize(_distinct_pairs(pairs), "pairs")
    found = _similarity(ided, _distinct_texts(ided), embedder)
    return lookup_join(with_ids(pairs), found, PAIR_ID, spread_by=PAIR).select(*pairs.columns, "sbert_similarity")


# --- pair models --------------------------------------------------------------------------


def overlap_pair_model() -> PairModel:
    """Logits from shared words: a deterministic stand-in that needs no model file."""

    def predict(pairs: DataFrame) -> DataFrame:
        share = lexical.set_recall(
            F.array_distinct(F.split("premise", " ")), F.array_distinct(F.split("hypothesis", " "))
        )
        lean = F.lit(4.0) * share - F.lit(2.0)
        return pairs.withColumn("_lean", lean).select(
            "pair_id", F.array(F.col("_lean"), F.lit(0.0), -F.col("_lean")).alias("logits")
        )

    return PairModel(predict)


def python_pair_model(
    load: Callable[[], Callable[[list[str], list[str]], object]],
    labels: Sequence[str],
    batch_size: int = 8,
) -> PairModel:
    """Pair model from Python: ``load()`` runs once per task and returns a function from
    premises and hypotheses to an array of logits.  Truncation is the model's business."""

    def predict_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = load()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                logits = classify(part["premise"].tolist(), part["hypothesis"].tolist())
                yield pd.DataFrame({"pair_id": part["pair_id"].tolist(), "logits": list(logits)})

    def predict(pairs: DataFrame) -> DataFrame:
        return model_tasks(pairs).mapInPandas(predict_batches, "pair_id binary, logits array<double>")

    return PairModel(predict, tuple(labels))


def _premise_and_hypothesis(cfg: FeatureConfig) -> tuple[str, str]:
    return (PAIR[1], PAIR[0]) if cfg.premise_first == "response" else (PAIR[0], PAIR[1])


def _pair_classes(pairs: DataFrame, model: PairModel, cfg: FeatureConfig) -> DataFrame:
    """Ids and the four class features of distinct pairs."""
    premise, hypothesis = _premise_and_hypothesis(cfg)
    pair_id = F.concat(*PAIR_ID)
    named = pairs.select(
        pair_id.alias("pair_id"), F.col(premise).alias("premise"), F.col(hypothesis).alias("hypothesis")
    )
    scored = model.predict(named).withColumn("_probabilities", softmax(F.col("logits")))
    return scored.select(
        F.substring("pair_id", 1, 16).alias(PAIR_ID[0]),
        F.substring("pair_id", 17, 16).alias(PAIR_ID[1]),
        *nli_columns(F.col("_probabilities"), label_positions(model.labels)),
    ).select(*PAIR_ID, *NLI_FEATURES)


def nli_features(pairs: DataFrame, model: PairModel, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The four class features of distinct pairs."""
    ided = _distinct_pairs(pairs)
    return _pair_classes(ided, model, cfg).join(ided, PAIR_ID).select(*PAIR, *NLI_FEATURES)


# --- assembly -----------------------------------------------------------------------------


def feature_names(cfg: FeatureConfig) -> list[str]:
    """Feature columns of the enabled engines, in fixed order."""
    return [
        *(lexical.LEXICAL_FEATURES if cfg.use_lemma_overlap else ()),
        *(("sbert_similarity",) if cfg.use_sbert else ()),
        *(NLI_FEATURES if cfg.use_nli else ()),
        *(("cross_encoder_similarity",) if cfg.use_cross_encoder else ()),
    ]


def model_features(df: DataFrame, models: Models, cfg: FeatureConfig) -> DataFrame:
    """Ids and model features of the distinct pairs in ``df``: equal pairs share one model call."""
    for engine, used, model in (
        ("sentence vectors", cfg.use_sbert, models.embedder),
        ("pair model", cfg.use_nli, models.pair_model),
    ):
        if used and model is None and not models.stand_ins:
            raise ValueError(f"{engine}: no model given (Models(stand_ins=True) runs the built-in stand-ins)")
    pairs = materialize(_distinct_pairs(df.filter(_both_texts())), "pairs")
    parts = []
    if cfg.use_sbert:
        parts.append(_similarity(pairs, _distinct_texts(pairs), models.embedder or hashed_embedder()))
    if cfg.use_nli:
        parts.append(_pair_classes(pairs, models.pair_model or overlap_pair_model(), cfg))
    if cfg.use_cross_encoder:
        if models.joint_model is None:
            raise ValueError("use_cross_encoder needs a joint model")
        score = joint_similarity(F.col("score")).alias("cross_encoder_similarity")
        parts.append(models.joint_model(pairs).select(*PAIR_ID, score))
    out = pairs.select(*PAIR_ID)
    for part in parts:
        out = out.join(part, PAIR_ID, "left")
    return materialize(out, "pair-features")


def extract_features(
    df: DataFrame, key: list[str], models: Models = Models(), cfg: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """Features of every row of ``df``; a row with an empty text gets zeros."""
    out = df
    if cfg.use_lemma_overlap:
        out = lexical_features(out, key, models.lexicon, cfg)
    if cfg.use_sbert or cfg.use_nli or cfg.use_cross_encoder:
        out = lookup_join(with_ids(out), model_features(df, models, cfg), PAIR_ID, spread_by=key)
    names = feature_names(cfg)
    return out.fillna(0, subset=names).select(*df.columns, *names)


def gated_features(
    df: DataFrame, key: list[str], models: Models = Models(), cfg: FeatureConfig = FeatureConfig()
) -> DataFrame:
    """Features where the gate left a row open, null features where it settled the score.

    Word overlap alone is a projection.  Models are kept from settled rows by a filter, as a
    conditional would not hold them back; ``df`` is then read several times and should be a
    stored table, or its cleaning is repeated inside every filter.
    """
    is_open = F.col("early_gate_score").isNull()
    names = feature_names(cfg)
    if set(names) <= set(lexical.LEXICAL_FEATURES) and models.lexicon is None:
        out = lexical_features(df, key, None, cfg, only=is_open) if names else df
        return out.withColumns({name: F.when(is_open, F.col(name)) for name in names})
    open_rows = extract_features(df.filter(is_open), key, models, cfg)
    return open_rows.unionByName(df.filter(~is_open), allowMissingColumns=True)
