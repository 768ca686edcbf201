"""Deterministic train / validation split of labelled rows, exact in size."""

from __future__ import annotations

import logging
import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rubrica.config import RUBRIC, SplitConfig

logger = logging.getLogger(__name__)

# Rows are cut by hash order.  Each round counts the rows of the interval in question over 16^4 prefixes that are
# longer by four digits, until the one prefix that is left has so few rows that they can be ranked.
PREFIX = 4
RANKED_ROWS = 10_000
DIGITS = 32


def validation_quotas(counts: dict[int, int], cfg: SplitConfig) -> dict[int, int]:
    """Validation rows per label: the training side is shared out by largest remainder.

    Ties between remainders go to the lower label.  Raises ``ValueError`` where a stratified
    split is impossible: a label with one row, or a side with fewer rows than labels.
    """
    n = sum(counts.values())
    n_val = math.ceil(n * cfg.validation_size)
    n_train = n - n_val
    if min(counts.values()) < 2 or min(n_train, n_val) < len(counts):
        raise ValueError("too few rows for a stratified split")
    train = {label: size * n_train // n for label, size in counts.items()}
    by_remainder = sorted(counts, key=lambda label: (-(counts[label] * n_train % n), label))
    for label in by_remainder[: n_train - sum(train.values())]:
        train[label] += 1
    return {label: counts[label] - train[label] for label in counts}


def split_labeled(
    df: DataFrame, row_id: str, label: str = "human_score", cfg: SplitConfig = SplitConfig()
) -> DataFrame:
    """Labelled rows with a ``split`` column: ``validation`` or ``train``.

    A row's place is the order of ``md5("seed|id")``, so the result does not depend on
    partitioning.  Instead of ranking whole strata, counts per hash prefix narrow down the interval in
    which each stratum reaches its quota, and only a few rows are ranked.  The outcome is one cut per
    stratum; the split itself is a comparison with it, row by row.
    """
    rows = df.filter(F.col(label).isNotNull())
    per_grade = [F.count_if(F.col(label) == grade).alias(str(grade)) for grade in RUBRIC]  # one row, whatever labels there are
    found = rows.agg(*per_grade, F.count_if(~F.col(label).isin(*RUBRIC)).alias("other")).first()
    if found["other"]:
        raise ValueError("labels must be grades 0 to 4")
    counts = {grade: found[str(grade)] for grade in RUBRIC if found[str(grade)]}
    if not counts:
        raise ValueError("no labelled rows to split")
    stratified = cfg.stratify
    if stratified:
        try:
            quotas = validation_quotas(counts, cfg)
        except ValueError as reason:
            logger.warning("splitting without strata: %s", reason)
            stratified = False
    if not stratified:
        n = sum(counts.values())
        quotas = {0: math.ceil(n * cfg.validation_size)}
        if quotas[0] >= n:
            raise ValueError("too few labelled rows to split")

    stratum = (F.col(label) if stratified else F.lit(0)).cast("int")
    digest = F.md5(F.concat(F.lit(f"{cfg.seed}|"), F.col(row_id).cast("string")))
    hashed = rows.select(F.col(row_id).alias("_id"), stratum.alias("_g"), digest.alias("_h"))
    cuts = _cuts(hashed, {int(g): q for g, q in quotas.items() if q > 0})

    def before(cut: Row) -> Column:
        earlier = (digest < cut["_h"]) | ((digest == cut["_h"]) & (F.col(row_id) <= cut["_id"]))
        return (stratum == cut["_g"]) & earlier

    is_validation = reduce(operator.or_, [before(cut) for cut in cuts], F.lit(False))
    return rows.withColumn("split", F.when(is_validation, "validation").otherwise("train"))


def _inside(prefixes: dict[int, str]) -> Column:
    """Rows of the given hash prefix of each stratum."""
    own = [(F.col("_g") == g) & F.col("_h").startswith(prefix) for g, prefix in prefixes.items()]
    return reduce(operator.or_, own, F.lit(False))


def _narrowed(hashed: DataFrame, prefixes: dict[int, str], ranks: dict[int, int]) -> list[Row]:
    """The longer prefix in which each stratum reaches its rank: one row per stratum."""
    length = len(next(iter(prefixes.values()))) + PREFIX
    rank = F.create_map(*[F.lit(x) for item in ranks.items() for x in item])[F.col("_g")]
    # One row per stratum and prefix: at most 16^4 rows a stratum.
    upto = Window.partitionBy("_g").orderBy("_prefix")
    row = F.struct("_h", "_id")
    return (
        hashed.filter(_inside(prefixes))
        .groupBy("_g", F.substring("_h", 1, length).alias("_prefix"))
        .agg(F.count("*").alias("_n"), F.min(row).alias("_first"), F.max(row).alias("_last"))
        .withColumns({"_upto": F.sum("_n").over(upto), "_quota": rank})
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select("_g", "_prefix", "_n", "_first", "_last", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_rank"))
        .collect()
    )


def _cuts(hashed: DataFrame, quotas: dict[int, int]) -> list[Row]:
    """The last row of each stratum (``_g``) that still belongs to its quota: one per stratum.

    Rows that repeat an id fall on the same side, so an interval of one id is a cut by itself.
    """
    cuts, few = [], {}
    wide, ranks = dict.fromkeys(quotas, ""), dict(quotas)
    while wide:
        found = _narrowed(hashed, wide, ranks)
        wide = {}
        for row in found:
            g = row["_g"]
            ranks[g] = row["_rank"]
            if row["_first"] == row["_last"]:
                cuts.append(Row(_g=g, _h=row["_last"]["_h"], _id=row["_last"]["_id"]))
            elif row["_n"] <= RANKED_ROWS or len(row["_prefix"]) >= DIGITS:
                few[g] = row["_prefix"]
            else:
                wide[g] = row["_prefix"]
    if few:
        rank = F.create_map(*[F.lit(x) for g in few for x in (g, ranks[g])])[F.col("_g")]
        in_order = Window.partitionBy("_g").orderBy("_h", "_id")
        ranked = hashed.filter(_inside(few)).withColumn("_place", F.row_number().over(in_order))
        cuts += ranked.filter(F.col("_place") == rank).select("_g", "_h", "_id").collect()
    return cuts
