"""Regressors, grid search and leaderboard.

Linear models are solved from moments (``linear``); forests and boosted trees grow on a grid of bins (``grid_trees``), or with more features than
such a grid can hold, by pyspark.ml.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from sedge.operators import grid_trees, linear
from sedge.operators.diagnostics import regression_metrics
from sedge.operators.splitting import row_hash

# Hyperparameter grids.
GRIDS: dict[str, dict[str, list]] = {
    "linreg": {},
    "enet": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.5, 0.9]},
    "rf": {"n_estimators": [200, 500], "max_depth": [None, 5, 10], "min_samples_split": [2, 5]},
    "gbr": {"n_estimators": [200, 500], "learning_rate": [0.05, 0.1], "max_depth": [2, 3, 4]},
}
DEEPEST_TREE = 30  # the largest depth Spark allows, for "no limit"


def select_models(enabled: Sequence[str] | None = None) -> dict[str, dict[str, list]]:
    """Grids of the enabled models; unknown names are ignored, nothing left is an error."""
    chosen = {n: GRIDS[n] for n in (GRIDS if enabled is None else enabled) if n in GRIDS}
    if not chosen:
        raise ValueError(f"no known models in {list(enabled or [])}")
    return chosen


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _estimator(name: str, seed: int):
    """The pyspark.ml regressor of a name, for grids that bins cannot hold."""
    common = {"featuresCol": "_x", "labelCol": "_label", "featureSubsetStrategy": "all", "seed": seed}
    return RandomForestRegressor(**common) if name == "rf" else GBTRegressor(**common)


def _param_map(name: str, model, point: Mapping) -> dict:
    """Grid point -> Spark parameters."""
    if name == "rf":
        return {
            model.numTrees: point["n_estimators"],
            model.maxDepth: point["max_depth"] or DEEPEST_TREE,
            model.minInstancesPerNode: max(1, point["min_samples_split"] // 2),
        }
    return {
        model.maxIter: point["n_estimators"],
        model.stepSize: point["learning_rate"],
        model.maxDepth: point["max_depth"],
    }


def _ml_search(train: DataFrame, name: str, features: Sequence[str], target: str, points: list[dict], folds: int, seed: int, parallelism: int):
    """Best point and its model by pyspark.ml's cross-validation."""
    model = _estimator(name, seed)
    prepared = train.withColumn("_label", F.col(f"`{target}`"))
    stages = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model])
    maps = [_param_map(name, model, p) for p in points]
    best, at = None, 0
    if len(maps) == 1:
        best = stages.fit(prepared, maps[0])
    else:
        search = CrossValidator(
            estimator=stages, estimatorParamMaps=maps, numFolds=folds, foldCol="_fold", parallelism=parallelism,
            evaluator=RegressionEvaluator(labelCol="_label", predictionCol="prediction", metricName="rmse"),
        ).fit(prepared)
        best, at = search.bestModel, min(range(len(maps)), key=lambda i: search.avgMetrics[i])
    named = SQLTransformer(statement="SELECT *, prediction AS y_pred FROM __THIS__")
    return points[at], PipelineModel(stages=[*best.stages, named])


@dataclass
class Trained:
    """Leaderboard, best first, with every fitted model and the predictions of the best."""

    leaderboard: DataFrame
    models: dict[str, PipelineModel]
    best_name: str
    predictions: DataFrame

    @property
    def best_model(self) -> PipelineModel:
        return self.models[self.best_name]


def train_models(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    id_columns: Sequence[str],
    split: str = "split",
    enabled: Sequence[str] | None = None,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
) -> Trained:
    """Fit every enabled model on the train rows, by grid search where it has a grid, and rank them.

    Folds are a hash of the row id, so a rerun sees the same ones. Models rank by
    validation RMSE, then by validation R2. A grid's error is the mean over the folds of the held-out RMSE.
    """
    chosen = select_models(enabled)
    if grids is not None:
        chosen = {n: grids.get(n, g) for n, g in chosen.items()}
    points = {n: grid_points(g) if g else [{}] for n, g in chosen.items()}
    rows = df.select(*id_columns, *[F.col(f"`{c}`") for c in [*features, target, split] if c not in id_columns])
    in_train = F.col(split) == "train"
    fold = F.when(in_train, F.pmod(row_hash(id_columns, seed + 1), F.lit(folds)).cast("int"))
    row = F.when(in_train, row_hash(id_columns, seed + 2))
    unread = [c for c in id_columns if c not in (*features, target, split)]
    cached = rows.withColumns({"_fold": fold, "_row": row}).drop(*unread).persist(StorageLevel.MEMORY_AND_DISK)
    train = cached.where(in_train)
    columns = [*features, target]
    by_fold: dict = {}
    grid = grid_trees.bins_of(train, features) if {"rf", "gbr"} & set(chosen) else None
    sums = grid_trees.cell_sums(train, grid, target, "_fold") if grid else None

    def fitted(name: str) -> tuple[dict, PipelineModel]:
        """The grid point with the smallest held-out error, the first of equals, fitted on all train rows."""
        if name in ("linreg", "enet"):
            if not by_fold:
                by_fold.update(linear.moments(train, columns, "_fold"))
            if name == "linreg":
                best, line = {}, linear.least_squares(linear.merged(by_fold.values(), len(columns)))
            else:
                errors, every = linear.search(by_fold, points[name]) if len(points[name]) > 1 else ([0.0], linear.merged(by_fold.values(), len(columns)))
                best = points[name][errors.index(min(errors))]
                line = linear.elastic_net(every, **best)
            return best, PipelineModel(stages=[line.stage(features)])
        if sums is None:
            return _ml_search(train, name, features, target, points[name], folds, seed, parallelism)
        if name == "rf":
            errors, _, tables = grid_trees.search_forest(train, sums, target, "_fold", "_row", chosen[name])
        else:
            errors, _, tables = grid_trees.search_boosting(df.sparkSession, sums, chosen[name])
        at = errors.index(min(errors))
        return points[name][at], PipelineModel(stages=[grid_trees.GridModel(grid, tables[at])])

    def predictions(of: DataFrame, names: Sequence[str]) -> DataFrame:
        parts = [
            models[n].transform(of.where(F.col(split) != "train")).select(
                F.lit(n).alias("model"), F.col(split).alias("split"), F.col(f"`{target}`").alias("y_true"), "y_pred"
            )
            for n in names
        ]
        return reduce(DataFrame.unionByName, parts)

    models: dict[str, PipelineModel] = {}
    facts = []
    try:
        for name in chosen:
            began = time.time()
            params, models[name] = fitted(name)
            facts.append((name, round(time.time() - began, 2), json.dumps(params)))

        metrics = regression_metrics(predictions(cached, list(models)), "y_true", "y_pred", ["model", "split"])
        at = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
        wide = metrics.groupBy("model").agg(
            at("rmse", "test").alias("rmse_test"), at("r2", "test").alias("r2_test"),
            at("rmse", "validation").alias("rmse_val"), at("r2", "validation").alias("r2_val"),
        )
        spent = df.sparkSession.createDataFrame(facts, "model string, fit_seconds double, best_params string")
        ranked = wide.join(spent, "model").orderBy("rmse_val", F.desc("r2_val"), "model")
        standings = ranked.collect()  # one row per model
    finally:
        cached.unpersist()
    board = df.sparkSession.createDataFrame(standings, ranked.schema)
    best_name = standings[0]["model"]
    return Trained(board, models, best_name, predictions(rows, [best_name]).drop("model"))
