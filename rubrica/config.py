"""Settings of the engine: frozen dataclasses, checked when they are built.

Defaults are the shipped settings.  ``ExperimentConfig.from_mapping`` accepts the
nested mapping a YAML settings file would give and reads the same keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from numbers import Real

RUBRIC = (0, 1, 2, 3, 4)

# Transcription artefacts to strip and markers of unintelligible speech.
NOISE_TAGS = ("[pause]", "[cough]", "[laugh]", "[gibberish]", "[en inglés]")
GIBBERISH_MARKERS = ("xxx", "xx", "x")

# Parts of speech that carry an idea unit.
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")

# Spanish words read as numbers (cardinals, then ordinals).
NUMBER_WORDS = tuple(
    """cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce
    quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés
    veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve treinta cuarenta
    cincuenta sesenta setenta ochenta noventa cien mil millón billón trillón
    primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo undécimo
    duodécimo""".split()
)


@dataclass(frozen=True)
class IngestConfig:
    allowed_score_range: tuple[float, float] = (0, 4)
    force_reload: bool = False
    tuning_path: str | None = None
    holdout_path: str | None = None
    #: Tables of the catalog with a sheet column, instead of files.
    tuning_table: str | None = None
    holdout_table: str | None = None
    cache_dir: str | None = None
    #: Read a missing path as an empty table, and go on without workbooks that cannot be read.
    missing_ok: bool = False
    skip_unreadable: bool = False


@dataclass(frozen=True)
class CleanConfig:
    lowercase: bool = True
    remove_punctuation: bool = True
    normalize_accents: bool = True
    noise_tags: tuple[str, ...] = NOISE_TAGS
    gibberish_markers: tuple[str, ...] = GIBBERISH_MARKERS


@dataclass(frozen=True)
class FeatureConfig:
    use_lemma_overlap: bool = True
    use_sbert: bool = True
    use_nli: bool = True
    use_cross_encoder: bool = False
    content_pos: tuple[str, ...] = CONTENT_POS
    remove_stopwords_for_ideas: bool = True
    number_words: tuple[str, ...] = NUMBER_WORDS
    premise_first: str = "stimulus"
    batch_size: int = 8
    max_length: int = 256

    @property
    def enabled_engines(self) -> list[str]:
        flags = {"linguistic": self.use_lemma_overlap, "sbert": self.use_sbert, "nli": self.use_nli}
        return [name for name, on in flags.items() if on]


def _check_numbers(values: Sequence, size: int, name: str) -> tuple[float, ...]:
    if not isinstance(values, (list, tuple)) or len(values) != size:
        raise ValueError(f"{name} must hold {size} numbers")
    if not all(isinstance(v, Real) and 0.0 <= v <= 1.0 for v in values):
        raise ValueError(f"{name} must be numbers within [0, 1]")
    return tuple(float(v) for v in values)


def check_cuts(cuts: Sequence[float], name: str = "thresholds", strict: bool = True) -> tuple[float, ...]:
    """Four cut points in [0, 1]: strictly increasing, or with ties where ``strict`` is off."""
    out = _check_numbers(cuts, len(RUBRIC) - 1, name)
    if any(a > b or (strict and a == b) for a, b in zip(out, out[1:])):
        raise ValueError(f"{name} must be increasing")
    return out


@dataclass(frozen=True)
class HeuristicConfig:
    weights: Mapping[str, float] = field(
        default_factory=lambda: {"nli_margin": 0.55, "sbert_similarity": 0.30, "lemma_recall": 0.15}
    )
    thresholds: tuple[float, ...] = (0.20, 0.40, 0.60, 0.85)

    # Used where a settings mapping gives no weights at all.
    FALLBACK_WEIGHTS = {"nli_margin": 0.50, "sbert_similarity": 0.30, "lemma_recall": 0.20}

    def __post_init__(self):
        if not isinstance(self.weights, Mapping) or not self.weights:
            raise ValueError("weights must be a non-empty mapping")
        for name, weight in self.weights.items():
            if not isinstance(name, str) or not name.strip():
                raise ValueError("weight names must be non-blank strings")
            if not isinstance(weight, Real):
                raise ValueError(f"weight of {name!r} must be a number")
            if weight < 0:
                raise ValueError(f"weight of {name!r} must not be negative")
        if sum(self.weights.values()) <= 0:
            raise ValueError("weights must add up to more than 0")
        object.__setattr__(self, "thresholds", check_cuts(self.thresholds, "heuristic_thresholds", strict=False))

    @property
    def normalized_weights(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return {name: weight / total for name, weight in self.weights.items()}


@dataclass(frozen=True)
class ThresholdSearchConfig:
    initial: tuple[float, ...] = (0.20, 0.40, 0.60, 0.85)
    bounds: tuple[tuple[float, float], ...] = ((0.0, 0.4), (0.2, 0.7), (0.4, 0.9), (0.6, 1.0))
    grid_step: float = 0.05
    maxiter: int = 1000

    def __post_init__(self):
        object.__setattr__(self, "initial", check_cuts(self.initial, "initial thresholds"))
        if len(self.bounds) != len(self.initial):
            raise ValueError("one (low, high) pair per threshold is needed")
        for pair in self.bounds:
            if not isinstance(pair, (list, tuple)) or len(pair) != 2 or not 0.0 <= pair[0] < pair[1] <= 1.0:
                raise ValueError(f"bounds must satisfy 0 <= low < high <= 1, got {pair!r}")


@dataclass(frozen=True)
class OrdinalConfig:
    features: tuple[str, ...] = (
        "nli_margin",
        "nli_entailment",
        "nli_contradiction",
        "sbert_similarity",
        "lemma_recall",
    )
    model_type: str = "logistic_regression"
    lr_max_iter: int = 1000
    lr_c: float = 1.0
    rf_trees: int = 100
    rf_max_depth: int = 5
    rf_min_samples_leaf: int = 1
    include_gated: bool = True
    seed: int = 42


@dataclass(frozen=True)
class SplitConfig:
    validation_size: float = 0.20
    seed: int = 42
    stratify: bool = True


@dataclass(frozen=True)
class ExperimentConfig:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    clean: CleanConfig = field(default_factory=CleanConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    heuristic: HeuristicConfig = field(default_factory=HeuristicConfig)
    search: ThresholdSearchConfig = field(default_factory=ThresholdSearchConfig)
    ordinal: OrdinalConfig = field(default_factory=OrdinalConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    output_dir: str | None = None

    @classmethod
    def from_mapping(cls, cfg: Mapping) -> "ExperimentConfig":
        """Settings from a nested mapping; absent keys take the documented defaults."""
        paths, data = cfg.get("paths", {}), cfg.get("dataset", {})
        feats, models = cfg.get("features", {}), cfg.get("models", {})
        engine, evaluation = cfg.get("scoring_engine", {}), cfg.get("evaluation", {})
        optim, cuts = cfg.get("optimization", {}), cfg.get("thresholds", {})
        seed = int(cfg.get("project", {}).get("seed", 42))
        if int(engine.get("rf_min_samples_split", 2)) != 2:
            raise ValueError("rf_min_samples_split other than 2 has no Spark ML counterpart")
        if engine.get("lr_solver", "lbfgs") != "lbfgs":
            raise ValueError("lr_solver other than lbfgs has no Spark ML counterpart")

        limits = optim.get("grid_search", {}).get("bounds", {})
        base = ThresholdSearchConfig()
        raw_dir = str(paths.get("raw_data_dir", "data/raw/")).rstrip("/")

        def under_raw(key: str) -> str | None:
            return f"{raw_dir}/{data[key]}" if data.get(key) else None

        return cls(
            ingest=IngestConfig(
                allowed_score_range=tuple(data.get("allowed_score_range", (0, 4))),
                force_reload=bool(data.get("force_reload", False)),
                tuning_path=under_raw("tuning_set"),
                holdout_path=under_raw("holdout_test_set"),
                tuning_table=data.get("tuning_table"),
                holdout_table=data.get("holdout_table"),
                cache_dir=paths.get("cache_dir"),
                missing_ok=bool(data.get("missing_ok", False)),
                skip_unreadable=bool(data.get("skip_unreadable", False)),
            ),
            clean=clean_config(cfg),
            features=FeatureConfig(
                use_lemma_overlap=feats.get("use_lemma_overlap", True),
                use_sbert=feats.get("use_sbert", True),
                use_nli=feats.get("use_nli", True),
                use_cross_encoder=feats.get("use_cross_encoder", False),
                content_pos=tuple(feats.get("content_pos_tags", CONTENT_POS)),
                remove_stopwords_for_ideas=feats.get("remove_stopwords_for_ideas", True),
                premise_first=feats.get("nli_premise_first", "stimulus"),
                batch_size=int(models.get("batch_size", 8)),
                max_length=int(models.get("max_length", 256)),
            ),
            heuristic=HeuristicConfig(
                weights=engine.get("weights", HeuristicConfig.FALLBACK_WEIGHTS),
                thresholds=engine.get("heuristic_thresholds", base.initial),
            ),
            search=ThresholdSearchConfig(
                initial=tuple(float(cuts.get(f"T{i}", base.initial[i - 1])) for i in range(1, 5)),
                bounds=tuple(
                    (float(limits.get(f"T{i}_min", low)), float(limits.get(f"T{i}_max", high)))
                    for i, (low, high) in enumerate(base.bounds, start=1)
                ),
                maxiter=int(optim.get("maxiter", 1000)),
            ),
            ordinal=OrdinalConfig(
                features=tuple(engine.get("ml_features", OrdinalConfig.features)),
                model_type=engine.get("ml_model_type", "logistic_regression"),
                lr_max_iter=int(engine.get("lr_max_iter", 1000)),
                lr_c=float(engine.get("lr_C", 1.0)),
                rf_trees=int(engine.get("rf_n_estimators", 100)),
                rf_max_depth=int(engine.get("rf_max_depth", 5)),
                rf_min_samples_leaf=int(engine.get("rf_min_samples_leaf", 1)),
                seed=seed,
            ),
            split=SplitConfig(
                validation_size=float(evaluation.get("validation_size", 0.2)),
                seed=seed,
                stratify=bool(evaluation.get("stratify_validation", True)),
            ),
            output_dir=paths.get("processed_data_dir"),
        )


def clean_config(cfg: Mapping) -> CleanConfig:
    """Cleaning rules from the whole mapping or from its ``preprocessing`` part alone."""
    part = cfg.get("preprocessing", cfg)
    return CleanConfig(
        lowercase=part.get("lowercase", True),
        remove_punctuation=part.get("remove_punctuation", True),
        normalize_accents=part.get("normalize_accents", True),
        noise_tags=tuple(part.get("noise_tags_to_remove", ())),
        gibberish_markers=tuple(part.get("gibberish_markers", ())),
    )
