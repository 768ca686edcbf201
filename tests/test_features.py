import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubrica.config import FeatureConfig
from rubrica.functions import lexical
from rubrica.functions.pairs import joint_similarity, label_positions, nli_columns, softmax
from rubrica.functions.vectors import cosine
from rubrica.operators import features, lookup
from rubrica.operators.cleaning import gate_summary, preprocess_pairs, with_labels
from rubrica.session import materialize

LEXICON = "form string, lemma string, pos string, is_stop boolean"


def pairs(spark, *values):
    rows = [(i, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, clean_stimulus string, clean_response string")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_tokens(spark):
    texts = ["la casa la 12 tres _ casa", "", "3,5 -7 1/2 ½a x² ² a_b", "uno dos"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in rows.select(lexical.tokens(F.col("t")).alias("x")).collect()]
    assert got == [["la", "casa"], [], ["½a", "x²", "a_b"], []]


def test_overlap_of_words(spark):
    df = pairs(spark, ("a b c d", "a b e"), ("", "a"), ("a", ""), ("1 2", "a"), ("a a b", "b a"))
    got = by_id(features.lexical_features(df, ["id"]))
    assert (got[0].lemma_recall, got[0].lemma_precision) == (0.5, 0.6667)
    assert (got[0].stimulus_lemma_count, got[0].response_lemma_count) == (4, 3)
    for i in (1, 2):
        assert [got[i][f] for f in lexical.LEXICAL_FEATURES] == [0] * 8
    assert (got[3].lemma_recall, got[3].stimulus_lemma_count, got[3].response_lemma_count) == (0, 0, 1)
    assert got[4].lemma_recall == 1.0


def brute_force(stimulus, response, entries, cfg):
    def sets(text):
        lemmas, ideas = set(), set()
        for form in set(text.split()) - set(cfg.number_words):
            lemma, pos, stop = entries.get(form, (form, None, False))
            lemma = form if lemma.strip().lower() == "-pron-" else lemma.strip().lower()
            if not lemma:
                continue
            lemmas.add(lemma)
            if pos in cfg.content_pos and not (cfg.remove_stopwords_for_ideas and stop):
                ideas.add(lemma)
        return lemmas, ideas

    if not stimulus or not response:
        return [0] * 8
    (ls, is_), (lr, ir) = sets(stimulus), sets(response)
    share = lambda part, whole: round(len(part) / len(whole), 4) if whole else 0.0
    return [share(ls & lr, ls), share(is_ & ir, is_), share(ls & lr, lr), share(is_ & ir, ir),
            len(ls), len(lr), len(is_), len(ir)]


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("remove_stops", [True, False])
def test_lexicon_path_equals_brute_force(spark, monkeypatch, fits, remove_stops):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["el", "lo", "tres", ""]
    entries = {f"w{i}": (f"L{i // 3}" if i % 5 else " ", ["NOUN", "VERB", "DET"][i % 3], i % 7 == 0) for i in range(30)}
    entries |= {"el": ("EL", "DET", True), "lo": ("-PRON-", "PROPN", False)}
    text = lambda: " ".join(w for w in rng.choice(vocabulary, rng.integers(0, 9)) if w) or ""
    values = [(f"el {text()}".strip(), text()) for _ in range(300)] + [("", "el"), ("el", "")]
    monkeypatch.setattr(features, "fits_broadcast", lambda *_: fits)
    monkeypatch.setattr(lookup, "ROWS_PER_KEY", 20)
    lexicon = spark.createDataFrame([(f, *e) for f, e in entries.items()], LEXICON)
    cfg = FeatureConfig(remove_stopwords_for_ideas=remove_stops)
    got = by_id(features.lexical_features(pairs(spark, *values), ["id"], lexicon, cfg))
    assert len(got) == len(values)
    for i, (s, r) in enumerate(values):
        assert [got[i][f] for f in lexical.LEXICAL_FEATURES] == brute_force(s, r, entries, cfg), (s, r)


def test_lookup_join_with_a_hot_key(spark, monkeypatch):
    """A key with a third of all rows is spread; nothing is lost or doubled."""
    monkeypatch.setattr(lookup, "ROWS_PER_KEY", 100)
    big = spark.range(9000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4000)).alias("k")
    )
    small = spark.range(3990).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    small = small.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    want = {r.row: r.v for r in big.join(small, "k", "left").collect()}
    for fits in (True, False):
        got = lookup.lookup_join(big, small, ["k"], ["row"], small_fits=fits).collect()
        assert len(got) == 9000 and {r.row: r.v for r in got} == want
    assert lookup.fits_broadcast(small) and not lookup.fits_broadcast(small, max_bytes=1000)


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0])],
        "a array<float>, b array<float>",
    )
    got = [r.c for r in rows.select(cosine(F.col("a"), F.col("b"), unit=False).alias("c")).collect()]
    assert got == [0.6, 0.0, 0.0, 0.0, 0.96]


def test_label_positions():
    assert label_positions({0: "ENTAILMENT", 1: " Neutral", 2: "contradiction"}) == {"entailment": 0, "neutral": 1, "contradiction": 2}
    assert label_positions(["not_contradicted", "entails", "other"]) == {"contradiction": 0, "entailment": 1}


def test_nli_features(spark):
    rows = spark.createDataFrame([([2.0, 1.0, -1.0],), ([900.0, 0.0, -900.0],)], "l array<double>")
    probs = rows.withColumn("p", softmax(F.col("l")))
    got = probs.select(*nli_columns(F.col("p"), {"entailment": 0, "contradiction": 2})).collect()
    e = [math.exp(x) for x in (2, 1, -1)]
    p = [x / sum(e) for x in e]
    assert tuple(got[0]) == (round(p[0], 4), 0.0, round(p[2], 4), round(p[0] - p[2], 4))
    assert tuple(got[1]) == (1.0, 0.0, 0.0, 1.0)


def test_joint_similarity(spark):
    rows = spark.createDataFrame([(1.5,), (-0.2,), (0.12345,), (None,), (math.nan,)], "s double")
    assert [r.x for r in rows.select(joint_similarity(F.col("s")).alias("x")).collect()] == [1.0, 0.0, 0.1235, 0.0, 0.0]


def gated(spark, tmp=None):
    rows = spark.createDataFrame(
        [
            (0, "Uno casa", "uno casa", "4"), (1, "la casa", "[pause]", "0"), (2, "la casa roja", "casa roja", "3"),
            (3, "(", "algo", None), (4, "la casa roja", "casa roja", "2"), (5, "el perro", "el gato", "x"),
        ],
        "id long, stimulus string, transcription string, score string",
    )
    return preprocess_pairs(with_labels(rows))


def test_gate_routing(spark):
    df = gated(spark)
    assert gate_summary(df).first().asDict() == {"n_rows": 6, "labelled": 4, "score_0": 1, "score_4": 1, "needs_features": 4}
    seen = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            seen.add(len(texts))
            return np.array([[float(len(t)), 1.0] for t in texts]) / np.array([[math.hypot(len(t), 1)] for t in texts])

        return encode

    def load_pairs():
        def classify(premises, hypotheses):
            assert all(premises) and all(hypotheses)
            return [[float(len(p)), 0.0, float(len(h))] for p, h in zip(premises, hypotheses)]

        return classify

    models = features.Models(
        embedder=features.python_embedder(load, batch_size=2),
        pair_model=features.python_pair_model(load_pairs, ["entailment", "neutral", "contradiction"]),
    )
    out = by_id(features.gated_features(materialize(df, "t"), ["id"], models))
    names = features.feature_names(FeatureConfig())
    for i in (0, 1):
        assert all(out[i][n] is None for n in names)
    assert out[3].nli_margin == 0 and out[3].sbert_similarity == 0 and out[3].stimulus_lemma_count == 0
    assert out[2].nli_margin == round(math.tanh((12 - 9) / 2) * (math.exp(12) + math.exp(9)) / (1 + math.exp(12) + math.exp(9)), 4)
    assert [out[2][n] for n in names] == [out[4][n] for n in names]
    # Texts of open pairs only, each distinct text once.
    assert seen.value == len({"la casa roja", "casa roja", "el perro", "el gato"})


def test_premise_order_and_joint_model(spark):
    df = materialize(gated(spark), "t")
    first = features.PairModel(
        lambda p: p.withColumn("logits", F.array(F.length("premise").cast("double"), F.lit(0.0), F.length("hypothesis").cast("double")))
    )
    joint = lambda p: p.withColumn("score", F.lit(0.5))
    cfg = FeatureConfig(use_lemma_overlap=False, use_sbert=False, use_cross_encoder=True)
    straight = by_id(features.gated_features(df, ["id"], features.Models(pair_model=first, joint_model=joint), cfg))
    swapped_cfg = FeatureConfig(use_lemma_overlap=False, use_sbert=False, premise_first="response")
    swapped = by_id(features.gated_features(df, ["id"], features.Models(pair_model=first), swapped_cfg))
    assert straight[2].nli_margin == -swapped[2].nli_margin > 0
    assert straight[2].cross_encoder_similarity == 0.5 and straight[3].cross_encoder_similarity == 0
    assert "lemma_recall" not in straight[2].asDict()
    assert features.feature_names(FeatureConfig(False, False, False)) == []
    with pytest.raises(ValueError):
        features.extract_features(df, ["id"], cfg=cfg)


def test_models_run_below_the_gate(spark, plan_of):
    """The gate's filter sits under the Python node; word overlap has no Python at all."""
    df = materialize(gated(spark), "t")
    open_pairs = df.filter(F.col("early_gate_score").isNull()).select(*features.PAIR)
    model = features.python_pair_model(lambda: None, ["entailment"])
    plan = plan_of(features.nli_features(open_pairs, model))
    assert plan.index("MapInPandas") < plan.index("isnull(early_gate_score")
    assert "PushedFilters: [IsNull(early_gate_score)]" in plan
    only_words = FeatureConfig(use_sbert=False, use_nli=False)
    plan = plan_of(features.gated_features(gated(spark), ["id"], cfg=only_words))
    assert "Python" not in plan and "Exchange" not in plan and "Pandas" not in plan
