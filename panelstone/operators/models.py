"""Supervised ranking models on the panel with MLlib: fit before a split date, judge after it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstone.operators.calendar import session_index
from panelstone.operators.evaluate import time_split
from panelstone.operators.factor import sanitise
from panelstone.session import cut_lineage, stacked


def estimator(kind: str, target: str, seed: int = 42):
    if kind == "gradient_boosting":
        return GBTRegressor(labelCol=target, maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if kind == "random_forest":
        return RandomForestRegressor(labelCol=target, numTrees=30, maxDepth=6, minInstancesPerNode=2, seed=seed)
    raise ValueError(f"unknown model {kind!r}")


def prepare(df: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    """Clean, impute and assemble; kept as a table because every boosting round reads it."""
    clean = sanitise(df.select(*keep, *features, target), features, target)
    return cut_lineage(VectorAssembler(inputCols=features, outputCol="features").transform(clean).select(*keep, "features", target))


def fit_predict(df: DataFrame, features: list[str], target: str, fraction: float, kind: str, entity: str = "company_id"):
    data = time_split(prepare(df, features, target, [entity, "date"]), fraction)
    model = estimator(kind, target).fit(data.where("split = 'train'"))
    return model, model.transform(data.where("split = 'test'")).select(entity, "date", F.col("prediction"), target)


def accuracy(scored: DataFrame, target: str) -> DataFrame:
    """R-squared and root mean squared error, from aggregates."""
    err = F.col(target) - F.col("prediction")
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("_res"), (F.var_pop(target) * F.count(F.lit(1))).alias("_tot"))
    return sums.select("n", (1 - F.try_divide("_res", "_tot")).alias("r2"), F.sqrt(F.try_divide(F.col("_res"), F.col("n"))).alias("rmse"))


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """One row per feature, most important first."""
    rows = sorted(zip(features, (float(x) for x in model.featureImportances.toArray())), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def rolling_validation(df: DataFrame, features: list[str], target: str, folds: int, kind: str, entity: str = "company_id") -> DataFrame:
    """Expanding folds over the date index; a fold trains on the dates before its cut and is judged on the next twentieth."""
    data = prepare(df, features, target, [entity, "date"])
    idx = cut_lineage(session_index(data.select("date").distinct()))
    n = idx.count()
    tagged = data.join(F.broadcast(idx), "date")  # one row per date
    out = []
    for fold in range(folds):
        cut = max(5, int(n * (0.5 + 0.4 * fold / max(folds - 1, 1))))
        model = estimator(kind, target).fit(tagged.where(F.col("idx") < cut))
        judged = model.transform(tagged.where((F.col("idx") >= cut) & (F.col("idx") < cut + max(5, n // 20))))
        out.append(accuracy(judged, target).withColumn("fold", F.lit(fold)))
    return reduce(stacked, out)


def evaluator(target: str, metric: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName=metric)
