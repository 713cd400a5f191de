"""Model life cycle under one root folder: bytes, metadata and the registry events.

Every save writes to a folder of its own and then appends one event, so a reader sees either
the old or the new model, and a save that failed half way leaves no entry.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import forecast, forest, registry
from tallyloom.session import remove


def _log_path(root: str) -> str:
    return f"{root}/registry"


def log(spark: SparkSession, root: str) -> DataFrame:
    """Registry events below ``root``; empty if there are none."""
    return registry.scan(spark, _log_path(root))


def _event(spark, root, model_type, name, path, metadata, event) -> None:
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
    row = (model_type, name, path, metadata, now, time.time_ns(), event)
    registry.write(spark.createDataFrame([row], registry.SCHEMA).coalesce(1), _log_path(root))


def _new_path(root: str, model_type: str, name: str) -> str:
    return f"{root}/{model_type}/{name}/{uuid.uuid4().hex}"


def save_baseline(
    g: DataFrame, root: str, name: str, window_size: int = forecast.DEFAULT_WINDOW,
    alpha: float = forecast.DEFAULT_ALPHA, custom: dict | None = None,
) -> str:
    """Save the fitted series and parameters and register ``baseline/name``."""
    spark = g.sparkSession
    path = _new_path(root, "baseline", name)
    forecast.save_baseline(g, path, window_size, alpha)
    stats = spark.read.parquet(f"{path}/series").agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")).first()
    info = {"model_type": "BaselineForecaster", "window_size": window_size, "alpha": alpha,
            "is_trained": True, "scaler_mean": stats["mean"], "scaler_std": stats["std"]}
    meta = {"model_name": name, "model_info": info, "custom_metadata": custom or {}}
    _event(spark, root, "baseline", name, path, json.dumps(meta), "save")
    return path


def save_forest(
    model: PipelineModel, features: list[str], root: str, name: str,
    metrics: dict | None = None, custom: dict | None = None,
) -> str:
    """Save a trained forest and register ``random_forest/name``."""
    spark = SparkSession.active()
    path = _new_path(root, "random_forest", name)
    forest.save(model, path)
    trees = forest.forest_of(model)
    info = {"model_type": "RandomForest", "n_estimators": trees.getNumTrees,
            "max_depth": trees.getMaxDepth(), "min_samples_leaf": trees.getMinInstancesPerNode(),
            "random_state": trees.getSeed(), "feature_count": len(features),
            "has_scaler": len(model.stages) == 3}
    meta = {"model_name": name, "model_info": info, "feature_names": features,
            "training_metrics": metrics or {}, "custom_metadata": custom or {}}
    _event(spark, root, "random_forest", name, path, json.dumps(meta), "save")
    return path


def _entry(spark: SparkSession, root: str, model_type: str, name: str):
    return registry.get(log(spark, root), model_type, name).first()


def load_baseline(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, int, float]:
    """(series, window_size, alpha) of the registered model; an unknown name is an error."""
    return forecast.load_baseline(spark, _entry(spark, root, "baseline", name)["path"])


def load_forest(spark: SparkSession, root: str, name: str) -> tuple[PipelineModel, list[str]]:
    """(model, feature names) of the registered model; an unknown name is an error."""
    entry = _entry(spark, root, "random_forest", name)
    return forest.load(entry["path"]), json.loads(entry["metadata"])["feature_names"]


def delete(spark: SparkSession, root: str, model_type: str, name: str, keep_bytes: bool = False) -> None:
    """Take a model out of the registry, then delete its bytes and those of its earlier saves; an
    unknown name is an error. Whoever is reading the model meanwhile loses it (``keep_bytes``
    leaves the folders)."""
    entry = _entry(spark, root, model_type, name)
    _event(spark, root, model_type, name, entry["path"], None, "delete")
    if not keep_bytes:
        remove(spark, f"{root}/{model_type}/{name}")
