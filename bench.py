"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default: all).  Every
query is run to its end through the no-op sink; model fitting counts as part of its query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rubrica.plans import fixtures  # noqa: E402
from rubrica.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "load_dedup_first",
    "load_report",
    "row_numbering",
    "clean_documents",
    "clean_noisy_pairs",
    "gate_summary",
    "eda_exact_match",
    "word_overlap",
    "lemma_overlap",
    "vector_cosine",
    "model_features",
    "rubric",
    "agreement",
    "class_report",
    "stratified_split",
    "threshold_grid_best",
    "threshold_refined",
    "ordinal_logistic",
    "holdout_score",
    "overlap_agreement",
    "experiment_summary",
)


def throughput(spark: SparkSession, sf_dir: str, seconds: dict[str, float]) -> dict[str, int]:
    """Pairs cleaned, gated, scored and evaluated, and rated rows fitted, per second."""
    sizes = {
        "overlap_agreement": lambda: QUERIES["gate_summary"](spark, sf_dir).first()["n_rows"],
        "threshold_refined": lambda: fixtures.rated(spark, sf_dir).count(),
    }
    return {name: round(size() / seconds[name]) for name, size in sizes.items() if name in seconds}


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as scratch:
        run(scratch)


def run(scratch: str) -> None:
    """All intermediate tables go to ``scratch``."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir,
        "rows_per_second": throughput(spark, sf_dir, seconds),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
