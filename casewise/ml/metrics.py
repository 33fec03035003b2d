"""Metrics of scored rows (columns label int, score double) as relational plans.

Scores are first counted by distinct value, so what is ordered is one row a score, not one a case; cumulative
counts run over ranges of scores (``operators.ordered``), so no task holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles, prefix_sums


def by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))


def _from_highest(scored: DataFrame) -> DataFrame:
    """(score, p, n, tp, fp): counts at each distinct score and over all scores from it on upwards."""
    placed = prefix_sums(by_score(scored), "score", ["p", "n"], descending=True)
    return placed.select("score", "p", "n", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_n") + F.col("n")).alias("fp"))


def roc_points(scored: DataFrame) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at each distinct score, highest first."""
    rows = _from_highest(scored)
    total = rows.agg(F.sum("p").alias("__pos"), F.sum("n").alias("__neg"))
    points = rows.crossJoin(F.broadcast(total))  # with one row
    return points.select(
        F.col("score").alias("threshold"), "tp", "fp",
        F.coalesce(F.try_divide("tp", "__pos"), F.lit(0.0)).alias("tpr"), F.coalesce(F.try_divide("fp", "__neg"), F.lit(0.0)).alias("fpr"),
    )


def auc(scored: DataFrame) -> DataFrame:
    """(roc_auc): pairs ranked right, ties counting half; null without both labels."""
    below = prefix_sums(by_score(scored), "score", ["n"])
    one = below.agg(F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return one.select(F.try_divide("u", F.col("pos") * F.col("neg")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(average_precision): precision at each distinct score times the recall gained there."""
    one = _from_highest(scored).agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("p").alias("pos"))
    return one.select(F.try_divide("s", "pos").alias("average_precision"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and the rates made of them; rates over nothing are 0."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    one = scored.agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")
    )

    def rate(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select(
        "tp", "fp", "fn", "tn", rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tn, tn + fp).alias("specificity"),
    )


def youden_threshold(scored: DataFrame) -> DataFrame:
    """(threshold, youden_j): the first, that is highest, score at which tpr - fpr is largest."""
    points = roc_points(scored).withColumn("youden_j", F.round(F.col("tpr") - F.col("fpr"), 12))
    return points.orderBy(F.desc("youden_j"), F.desc("threshold")).limit(1).select("threshold", "youden_j")


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, event_rate) over right-closed quantile bins, numbered from 1.

    There are no more bins than distinct scores, and equal edges are merged; one score is one bin.
    """
    bins = max(1, min(bins, scored.select("score").distinct().limit(bins).count()))
    edges = exact_quantiles(scored, "score", [i / bins for i in range(bins + 1)]).first().quantiles  # bins + 1 numbers
    edges = sorted(set(edges or []))
    place = F.lit(max(len(edges) - 1, 1))
    for i in range(len(edges) - 2, 0, -1):
        place = F.when(F.col("score") <= edges[i], i).otherwise(place)
    rows = scored.withColumn("bin", place)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("event_rate"))


def all_metrics(scored: DataFrame, threshold: float = 0.5) -> dict[str, float | None]:
    row = auc(scored).first().asDict() | average_precision(scored).first().asDict() | brier(scored).first().asDict()
    return row | confusion(scored, threshold).first().asDict()
