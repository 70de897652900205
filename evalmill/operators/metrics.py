"""Forecast and compliance metrics with explicit denominators.

Scores are integer basis points, so sums are exact whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import share
from ..session import cut_lineage
from .ranking import exact_median


def _times(weight: str | None):
    """How many rows a row stands for."""
    return F.lit(1) if weight is None else F.col(weight)


def _count_if(condition, weight: str | None):
    return F.coalesce(F.sum(F.when(condition, _times(weight))), F.lit(0))


def rank_auc(df: DataFrame, group: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """group, n_pos, n_neg, roc_auc: the chance that a positive outscores a negative, ties half.

    Rows are first counted per distinct score, so a group is as large as its distinct scores and no
    row-level sort is needed. NULL scores or labels are left out; AUC is NULL without both classes.
    """
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(*group, score).agg(_count_if(F.col(label) == 1, weight).alias("pos"), _count_if(F.col(label) == 0, weight).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("wins2", F.col("pos") * (2 * below + F.col("neg")))
    out = wins.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins2").alias("wins2"))
    pairs = F.col("n_pos") * F.col("n_neg")
    return out.select(*group, "n_pos", "n_neg", F.when(pairs > 0, F.col("wins2") / (2 * pairs)).alias("roc_auc"))


def confusion(df: DataFrame, group: list[str], score: str, label: str, half: int, weight: str | None = None) -> DataFrame:
    """tp, fp, fn, tn at score >= half; precision and recall NULL on an empty denominator, F1 0.0 then."""
    said, was = F.col(score) >= half, F.col(label) == 1
    base = df.filter(F.col(score).isNotNull()).groupBy(*group).agg(
        *[_count_if(c, weight).alias(n) for n, c in (("tp", said & was), ("fp", said & ~was), ("fn", ~said & was), ("tn", ~said & ~was))]
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return base.select(
        *group, "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def brier(df: DataFrame, group: list[str], bp: str, label: str, unit: int, weight: str | None = None) -> DataFrame:
    """n, brier and the reference of always forecasting the base rate; bp / unit is the probability."""
    known = df.filter(F.col(bp).isNotNull() & F.col(label).isNotNull())
    miss = F.col(bp) - unit * F.col(label)
    out = known.groupBy(*group).agg(F.sum(_times(weight)).cast("bigint").alias("n"), F.sum(F.col(label).cast("bigint") * _times(weight)).alias("n_pos"), F.sum((miss * miss).cast("bigint") * _times(weight)).alias("sq"))
    n, pos = F.col("n"), F.col("n_pos")
    return out.select(*group, "n", "n_pos", (F.col("sq") / (n * unit * unit)).alias("brier"), (pos * (n - pos) / (n * n)).alias("brier_base_rate"))


def forecast_summary(df: DataFrame, group: list[str], half: int, unit: int) -> DataFrame:
    """The headline table over rows of bp, y, truncated, chars and ms.

    Unparsed rows stay in n and truncated but in no metric.
    """
    # all but the medians come from one table of the distinct (score, outcome) pairs, read once from the source
    table = cut_lineage(df.groupBy(*group, "bp", "y").agg(
        F.count(F.lit(1)).alias("w"), F.count_if("truncated").alias("cut"), F.count("chars").alias("n_chars"), F.count("ms").alias("n_ms")
    ))
    counts = table.groupBy(*group).agg(
        F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("bp").isNotNull(), F.col("w"))), F.lit(0)).alias("parsed"), F.sum("cut").alias("truncated"), F.sum(F.col("bp") * F.col("w")).alias("bp_sum")
    )
    sizes = table.groupBy(*group).agg(F.sum("n_chars").alias("n_chars"), F.sum("n_ms").alias("n_ms"))
    cells = table.filter("bp is not null and y is not null")
    out = counts
    for part in (
        exact_median(df, group, "chars", "median_chars", 4096, sizes.select(*group, F.col("n_chars").alias("_n"))),
        exact_median(df, group, "ms", "median_ms", 1 << 18, sizes.select(*group, F.col("n_ms").alias("_n"))),
        confusion(cells, group, "bp", "y", half, "w"),
        brier(cells, group, "bp", "y", unit, "w").drop("n", "n_pos"),
        rank_auc(cells, group, "bp", "y", "w").drop("n_pos", "n_neg"),
    ):
        out = out.join(part, group, "left")
    return out.withColumn("parse_rate", share(F.col("parsed"), F.col("n"))).withColumn("truncation_rate", share(F.col("truncated"), F.col("n"))).withColumn(
        "mean_forecast", F.when(F.col("parsed") > 0, F.col("bp_sum") / (F.col("parsed") * unit))
    ).drop("bp_sum")
