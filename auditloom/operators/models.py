"""Classifiers on feature tables: own scaler, Spark ML underneath."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.config import DEFAULT
from auditloom.functions.text import cleaned
from auditloom.operators.evaluate import auc_and_tpr, roc_points

#: Sizes of the boosted models by method (trees, depth, rate, share of rows, share of features, least rows of a leaf).
BOOSTED = {"casing": (200, 4, 0.1, 0.8, "all", 1), "neighbourhood": (300, 4, 0.05, 0.8, "all", 1), "pipeline": (150, 3, 0.05, 0.8, "all", 1), "combined": (300, 4, 0.05, 0.8, "0.8", 1), "lira": (500, 4, 0.05, 0.8, "0.7", 3)}


@dataclass
class Scaler:
    """M1: centres and divides by the population deviation of the fitted rows; a deviation of 0 counts as 1."""

    mean: dict[str, float]
    deviation: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> Scaler:
        row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
        return cls({f: row[f"m_{f}"] or 0.0 for f in features}, {f: row[f"s_{f}"] or 1.0 for f in features})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: (F.col(f) - self.mean[f]) / self.deviation[f] for f in self.mean})


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: cleaned(f) for f in features})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) = n / (2 n_class), of labelled rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(label, (F.col("total") / (2.0 * F.col("n"))).alias("weight"))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def fit_logistic(train: DataFrame, features: list[str], label: str, balanced: bool = False, c: float = 1.0) -> Model:
    """M2-M4: logistic regression with the penalty 1 / (C n)."""
    data = assembled(train.where(F.col(label).isNotNull()), features)
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(1, data.count())), elasticNetParam=0.0, standardization=False, maxIter=1000)
    if balanced:
        data = data.join(F.broadcast(class_weights(train, label)), label)
        lr = lr.setWeightCol("weight")
    return lr.fit(data)


def fit_boosted(train: DataFrame, features: list[str], label: str, method: str = "combined", trees: int | None = None) -> Model:
    """Gradient-boosted trees of the method's size (trees overrides their number)."""
    n, depth, rate, rows, share, leaf = BOOSTED[method]
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees or n, maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=share, minInstancesPerNode=leaf, seed=DEFAULT.seed)
    return gbt.fit(assembled(train.where(F.col(label).isNotNull()), features))


def probabilities(model: Model, df: DataFrame, features: list[str]) -> DataFrame:
    """Df with score, the probability of class 1."""
    return model.transform(assembled(df, features)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importances(model: Model, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance (trees) or absolute coefficient (logistic)."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else model.coefficients.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))


def ablation(train: DataFrame, test: DataFrame, families: dict[str, list[str]], label: str) -> DataFrame:
    """(family, n_features, auc, tpr_at_fpr) of a scaled logistic regression on each family alone."""
    rows = None
    for name, features in families.items():
        scaler = Scaler.fit(prepared(train, features), features)
        model = fit_logistic(scaler.transform(prepared(train, features)), features, label)
        scored = probabilities(model, scaler.transform(prepared(test, features)), features).select(F.lit(name).alias("family"), F.lit(len(features)).alias("n_features"), label, "score")
        rows = scored if rows is None else rows.unionByName(scored)
    metrics = auc_and_tpr(roc_points(rows, "family", "score", label), "family")
    return metrics.join(rows.select("family", "n_features").distinct(), "family").select("family", "n_features", "auc", "tpr_at_fpr")


def cross_validated(df: DataFrame, features: list[str], label: str, key: str = "id", folds: int = 5) -> DataFrame:
    """(fold, auc, tpr_at_fpr) of a scaled logistic regression, each fold of keys left out in turn; folds go by the keys' hashes."""
    own = prepared(df.where(F.col(label).isNotNull()), features).withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    rows = None
    for k in range(folds):
        train, test = own.where(F.col("__fold") != k), own.where(F.col("__fold") == k)
        scaler = Scaler.fit(train, features)
        scored = probabilities(fit_logistic(scaler.transform(train), features, label), scaler.transform(test), features).select(F.lit(k).alias("fold"), label, "score")
        rows = scored if rows is None else rows.unionByName(scored)
    return auc_and_tpr(roc_points(rows, "fold", "score", label), "fold")


def forward_selection(df: DataFrame, features: list[str], label: str, key: str = "id", most: int = 3, folds: int = 5) -> list[tuple[str, float]]:
    """Features added one by one, each time the one with the best mean AUC, as long as that grows: (feature, mean AUC)."""
    chosen: list[tuple[str, float]] = []
    while len(chosen) < most:
        names = [f for f, _ in chosen]
        tried = [(f, cross_validated(df, [*names, f], label, key, folds).agg(F.avg("auc")).first()[0] or 0.0) for f in features if f not in names]
        best = max(tried, key=lambda x: (x[1], x[0]), default=None)
        if best is None or chosen and best[1] <= chosen[-1][1]:
            break
        chosen.append(best)
    return chosen
