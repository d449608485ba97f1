"""Scores of predictions: area under the curve, accuracy, error; confusion by group and fairness gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import running_sums

#: A group with fewer rows has no rates.
LEAST_GROUP = 30


def roc_auc(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(*keys, auc): the share of pairs of a positive and a negative row in order, ties half; null without both. Equal scores
    are counted first, and only distinct scores are put in order."""
    keys = list(keys)
    by = scored.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ranked = running_sums(by, ["n"], keys, ["s"])
    pairs = F.sum(F.col("p") * (F.col("n_before") + F.col("n") * 0.5))
    return ranked.groupBy(*keys).agg(F.try_divide(pairs, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def accuracy(scored: DataFrame, keys: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg((F.col(pred).cast("string") == F.col(label).cast("string")).cast("int")).alias("accuracy"))


def rmse(scored: DataFrame, keys: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    return scored.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(pred), F.lit(2.0)))).alias("rmse"))


def confusion(scored: DataFrame, keys: Sequence[str] = ("client_id",), group: str = "group", least: int = LEAST_GROUP, whole_too: bool = False) -> DataFrame:
    """(*keys, group, tp, fp, tn, fn), without groups of fewer than `least` rows. scored: label and pred are 0 or 1. whole_too: also over
    all keys, which are null there, in the same pass; groups that are too small at every key may have a row there."""
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p))
    rows = scored.where(F.col(group).isNotNull()).withColumn("group", F.col(group))
    by = [*keys, "group"]
    groups = rows.groupingSets([[F.col(c) for c in by], [F.col("group")]], *by) if whole_too else rows.groupBy(*by)
    got = groups.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"), F.count("*").alias("n"))
    return got.where(F.col("n") >= least).drop("n")


def merge_confusion(partial: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """Cells of all clients together; groups that are still too small go (those dropped by a client stay lost)."""
    cells = ["tp", "fp", "tn", "fn"]
    return partial.groupBy("group").agg(*[F.sum(c).alias(c) for c in cells]).where(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") >= least)


def fairness_gaps(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, demographic_parity_diff, equal_opportunity_diff, equalized_odds_diff): spreads over the groups that have
    the rate; null where none has."""
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rates = cells.withColumns({"pr": d(tp + fp, tp + fp + tn + fn), "tpr": d(tp, tp + fn), "fpr": d(fp, fp + tn)})
    spread = lambda c: F.max(c) - F.min(c)
    got = rates.groupBy(*keys).agg(spread("pr").alias("demographic_parity_diff"), spread("tpr").alias("equal_opportunity_diff"), spread("fpr").alias("f"))
    odds = F.when(F.col("equal_opportunity_diff").isNotNull() & F.col("f").isNotNull(), F.greatest("equal_opportunity_diff", "f"))
    return got.withColumn("equalized_odds_diff", odds).drop("f")
