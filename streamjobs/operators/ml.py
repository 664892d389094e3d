"""Fraud classifier and regression of run metrics on knobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.randoms import hash_uniform
from streamjobs.operators.experiments import nonzero_columns
from streamjobs.operators.sampling import split_by_key
from streamjobs.operators.tree_training import BOOSTING, FOREST, TREES_AT_ONCE, Fits, Sizes, Training, TreeModel
from streamjobs.session import written


def train_svm(df: DataFrame, features: Sequence[str], label: str, max_iter: int = 100) -> PipelineModel:
    """Linear support vector machine on the assembled features."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    svc = LinearSVC(labelCol=label, predictionCol="prediction", maxIter=max_iter, regParam=0.0, tol=1e-6,
                    standardization=True)
    return Pipeline(stages=[assemble, svc]).fit(df)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, model: PipelineModel, label: str = "isFraud") -> DataFrame:
    """Label and prediction of each row; the same on a stream."""
    return model.transform(df).select(label, "prediction")


def confusion(scored: DataFrame, label: str = "isFraud") -> DataFrame:
    """Number of rows per (label, prediction)."""
    return scored.groupBy(label, "prediction").agg(F.count(F.lit(1)).alias("n_rows"))


def min_max_scale(train: DataFrame, other: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scale columns to [0, 1] by the extremes of ``train`` alone."""
    assemble = VectorAssembler(inputCols=list(cols), outputCol="_raw")
    model = Pipeline(stages=[assemble, MinMaxScaler(inputCol="_raw", outputCol="_scaled")]).fit(train)

    def scaled(df: DataFrame) -> DataFrame:
        values = vector_to_array("_scaled")
        out = model.transform(df).withColumns({c: values[i] for i, c in enumerate(cols)})
        return out.drop("_raw", "_scaled")

    return scaled(train), scaled(other)


def valid_mean(scores: Sequence[float]) -> tuple[float, float] | None:
    """Mean and deviation of the scores that are numbers; None without one."""
    valid = [s for s in scores if not math.isnan(s)]
    if not valid:
        return None
    mean = sum(valid) / len(valid)
    return mean, (sum((s - mean) ** 2 for s in valid) / len(valid)) ** 0.5


@dataclass
class StateModels:
    """What ``fit_state_models`` gives: models by target, the test runs, and the scores of both candidates.

    ``tested``: ``target, model, run, observed, predicted, cv_r2, cv_std``; ``scores``: ``target, model,
    n_scores, cv_r2, cv_std, chosen``.
    """

    models: dict[str, TreeModel]
    tested: DataFrame
    scores: DataFrame


def _thresholds(train: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cuts between the bins of each feature: its quantiles on the training runs."""
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = train.agg(*[F.percentile_approx(c, probs, 100 * bins).alias(c) for c in features]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in features]


def fit_state_models(df: DataFrame, index: str, features: Sequence[str], targets: Sequence[str], repeats: int = 10,
                     folds: int = 5, seed: int = 1000, train_share: float = 0.8, save_to: str | None = None,
                     parallelism: int | None = None, **sizes: int) -> StateModels:
    """One regression per metric on the knobs.

    Missing values count as 0, metrics that are 0 throughout are skipped, features and
    targets are scaled on the training part, and the candidate (boosting or forest, see
    ``tree_training.Sizes``) with the better cross-validated R² is taken as fitted on the
    whole training part. All folds of all repetitions, both candidates and all metrics are
    trained together (``tree_training``); the fold of a run is a function of its index.
    Folds without a score are left out, as is a metric for which no candidate has one. With
    ``save_to`` each model is saved there under the name of its metric and loaded again for
    the test runs.
    """
    spark, size = df.sparkSession, Sizes(**sizes)
    parallelism = parallelism or spark.sparkContext.defaultParallelism
    numbers = written(df.select(index, *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
                                         for c in [*features, *targets]]), "runs")
    held = nonzero_columns(numbers, targets)
    train, test = split_by_key(numbers.select(index, *features, *held), train_share, seed, [index])
    train, test = min_max_scale(train, test, [*features, *held])
    fold = [F.floor(hash_uniform(f"{seed}-{r}", F.col(index)) * folds).cast("int") for r in range(repeats)]
    train = written(train.select(*features, *held, F.array(*fold).alias("folds"), F.xxhash64(index).alias("key")), "training-runs")
    test = written(test, "test-runs")
    cuts = _thresholds(train, features, size.bins)
    models, tables, scores = {}, [], []
    at_once = max(1, TREES_AT_ONCE // (size.trees * (repeats * folds + 1)))
    for low in range(0, len(held), at_once):
        some = held[low:low + at_once]
        fits = Fits(len(some), repeats, folds)
        training = Training(train.select(*features, F.array(*some).alias("labels"), "folds", "key"), features, cuts, fits, size, parallelism)
        training.grow()
        found = training.scores()
        for k, target in enumerate(some):
            of = {name: [r2 for kind, fit, r2 in found if kind == name and fits.target(fit) == k] for name in (BOOSTING, FOREST)}
            scored = {name: m for name, r2s in of.items() if (m := valid_mean(r2s)) is not None}
            if not scored:
                continue
            name = max(sorted(scored), key=lambda n: scored[n][0])
            model = training.model(name, k, features)
            if save_to:
                model.save(spark, f"{save_to}/{target}")
                model = TreeModel.load(spark, f"{save_to}/{target}")
            models[target] = model
            scores += [(target, n, sum(not math.isnan(x) for x in of[n]), *scored[n], n == name) for n in scored]
            tables.append(model.transform(test).select(
                F.lit(target).alias("target"), F.lit(name).alias("model"), F.col(index).alias("run"),
                F.col(target).alias("observed"), F.col("prediction").alias("predicted"),
                *[F.lit(x).alias(c) for x, c in zip(scored[name], ("cv_r2", "cv_std"), strict=True)]))
    if not tables:
        raise ValueError("no target has a model: all are zero throughout or have no valid score")
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return StateModels(models, result, spark.createDataFrame(
        scores, "target string, model string, n_scores long, cv_r2 double, cv_std double, chosen boolean"))


def test_r2(table: DataFrame) -> DataFrame:
    """R² on the test runs per metric."""
    mean = table.groupBy("target").agg(F.avg("observed").alias("_mean"))
    joined = table.join(mean, "target")
    return joined.groupBy("target", "model").agg(
        (F.lit(1.0) - F.try_divide(F.sum(F.pow(F.col("observed") - F.col("predicted"), F.lit(2))),
                                   F.sum(F.pow(F.col("observed") - F.col("_mean"), F.lit(2))))).alias("test_r2"))
