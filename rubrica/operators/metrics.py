"""Agreement of predictions with labels: one pass to a confusion matrix, the rest on its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import RUBRIC
from rubrica.functions import agreement
from rubrica.functions.binding import bind
from rubrica.functions.numeric import round4

EXPERT_QWK = 0.80


def confusion_cells(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts ``n`` per (truth ``t``, prediction ``p``); rows without either are left out.

    They are left out by their count, after grouping: a filter on the prediction would be
    pushed below the scoring and would score every row a second time.
    """
    keys, both = by or [], F.col("t").isNotNull() & F.col("p").isNotNull()
    named = df.select(*keys, F.col(truth).alias("t"), F.col(pred).alias("p"))
    return named.groupBy(*keys, "t", "p").agg(F.count_if(both).alias("n")).filter(F.col("n") > 0)


def _cells(df: DataFrame, truth: str, pred: str, by: list[str] | None) -> DataFrame:
    counts = confusion_cells(df, truth, pred, by)
    # At most one entry per pair of labels.
    return counts.groupBy(*(by or [])).agg(F.collect_list(F.struct("t", "p", "n")).alias("cells"))


def evaluate(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """``n, qwk, accuracy, macro_f1`` (4 decimals), one row in all or per group of ``by``."""
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"])
    grouped = _cells(df, truth, pred, by)
    return grouped.select(*(by or []), total.alias("n"), *agreement.metric_columns(F.col("cells")))


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels=RUBRIC) -> DataFrame:
    """One row per label of truth, one column per label of prediction, zeros kept.

    A single aggregate without keys: every task sends one row of counts.
    """
    cell = "n_{}_{}".format
    counts = df.agg(
        *[
            F.count_if((F.col(truth) == i) & (F.col(pred) == j)).alias(cell(i, j))
            for i in labels
            for j in labels
        ]
    )
    rows = [
        F.struct(F.lit(i).alias("truth"), *[F.col(cell(i, j)).alias(f"pred_{j}") for j in labels])
        for i in labels
    ]
    return counts.select(F.inline(F.array(*rows)))


def classification_report(df: DataFrame, truth: str, pred: str, labels=RUBRIC) -> DataFrame:
    """Precision, recall, F1 and support per label, with accuracy and the two averages."""
    names = ("precision", "recall", "f1")

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def line(cells: Column, label: int) -> Column:
        hit, given, predicted = agreement.class_counts(cells, F.lit(label))
        return F.struct(
            F.lit(str(label)).alias("label"),
            ratio(hit, predicted).alias("precision"),
            ratio(hit, given).alias("recall"),
            ratio(F.lit(2.0) * hit, given + predicted).alias("f1"),
            given.alias("support"),
            hit.alias("hit"),
        )

    def total(lines: Column, value) -> Column:
        return F.aggregate(F.transform(lines, value), F.lit(0.0), lambda acc, x: acc + x)

    def summary(lines: Column, label: str, mean) -> Column:
        values = [mean(name).alias(name) for name in names]
        support = total(lines, lambda x: x["support"])
        return F.struct(F.lit(label).alias("label"), *values, support.alias("support"), F.lit(0.0).alias("hit"))

    def with_summaries(lines: Column) -> Column:
        support = total(lines, lambda x: x["support"])
        hits = total(lines, lambda x: x["hit"]) / support
        none = F.lit(None).cast("double")
        return F.concat(
            lines,
            F.array(
                summary(lines, "accuracy", lambda name: hits if name == "f1" else none),
                summary(lines, "macro avg", lambda name: total(lines, lambda x: x[name]) / len(labels)),
                summary(
                    lines, "weighted avg", lambda name: total(lines, lambda x: x[name] * x["support"]) / support
                ),
            ),
        )

    cells = _cells(df, truth, pred, None)
    lines = F.array(*[line(F.col("cells"), label) for label in labels])
    rows = cells.select(F.inline(bind(lines, with_summaries)))
    return rows.select(
        "label", *[round4(F.col(name)).alias(name) for name in names], F.col("support").cast("long").alias("support")
    )


def error_profile(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows by distance between truth and prediction."""
    distance = F.abs(F.col(truth) - F.col(pred)).cast("int")
    counts = df.select(distance.alias("off_by")).groupBy("off_by").agg(F.count("off_by").alias("n"))
    return counts.filter(F.col("n") > 0)


def agreement_level(qwk: Column) -> Column:
    return F.when(qwk >= EXPERT_QWK, "expert").otherwise("below_expert")
