"""Evaluation of scores against labels, per group (method, feature) in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.config import DEFAULT

#: Distinct scores of a group that one range holds about.
RANGE_ROWS = 500_000


def ranges(df: DataFrame, group: str, score: str, most: int) -> DataFrame:
    """df with __r, the number of the range of scores (cut at approximate quantiles of each group), about ``most`` rows each."""
    n = df.count()
    k = max(1, -(-n // most))
    if k == 1:
        return df.withColumn("__r", F.lit(0))
    cuts = df.groupBy(group).agg(F.percentile_approx(score, [i / k for i in range(1, k)], 10_000).alias("__c"))
    return df.join(F.broadcast(cuts), group).withColumn("__r", F.size(F.filter("__c", lambda c: c < F.col(score)))).drop("__c")


def roc_points(df: DataFrame, group: str, score: str, label: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group, score, pos, neg, tp, fp, n_pos, n_neg) of every distinct score, tp and fp counting scores >= it.

    Null labels, null and NaN scores take no part. Scores are counted before any order, each window covers one range of scores,
    and the ranges' totals (a few rows) are added: no task sees a whole group.
    """
    own = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    counted = own.groupBy(F.col(group).alias(group), F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    ranged = ranges(counted, group, "score", range_rows)
    totals = ranged.groupBy(group, "__r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.partitionBy(group).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(group)
    totals = totals.select(group, "__r", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.sum("p").over(every).alias("n_pos"), F.sum("n").over(every).alias("n_neg"))
    within = Window.partitionBy(group, "__r").orderBy(F.desc("score"))
    joined = ranged.join(F.broadcast(totals), [group, "__r"])
    return joined.select(group, "score", "pos", "neg", (F.col("p0") + F.sum("pos").over(within)).alias("tp"), (F.col("n0") + F.sum("neg").over(within)).alias("fp"), "n_pos", "n_neg")


def auc_and_tpr(points: DataFrame, group: str, target: float = DEFAULT.target_fpr) -> DataFrame:
    """(group, auc, tpr_at_fpr). Ties count one half; auc is null with one class only; tpr of the last point with fpr <= target."""
    below = F.col("n_neg") - F.col("fp")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    out = points.groupBy(group).agg(
        F.try_divide(area, F.first("n_pos") * F.first("n_neg").cast("double")).alias("auc"),
        F.coalesce(F.max(F.when(F.col("fp") <= target * F.col("n_neg"), F.try_divide(F.col("tp").cast("double"), F.col("n_pos")))), F.lit(0.0)).alias("tpr_at_fpr"),
    )
    return out


def unpivoted(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, value, label) rows of the feature columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.col(label).alias("label"), F.explode(pairs).alias("x")).select("label", "x.*")


def feature_aucs(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, auc, best_auc, direction) of every feature column."""
    auc = auc_and_tpr(roc_points(unpivoted(df, label, features), "feature", "value", "label"), "feature")
    best = F.greatest("auc", 1 - F.col("auc"))
    return auc.select("feature", "auc", "tpr_at_fpr", best.alias("best_auc"), F.when(F.col("auc") >= 0.5, "higher").when(F.col("auc") < 0.5, "lower").alias("direction"))


def accuracy_at_half(df: DataFrame, probability: str, label: str) -> DataFrame:
    """Share of labelled rows whose class at 0.5 is right."""
    return df.where(F.col(label).isNotNull()).agg(F.avg(F.when((F.col(probability) >= 0.5).cast("int") == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"))


