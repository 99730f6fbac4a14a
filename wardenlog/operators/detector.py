"""Ensemble anomaly detector: isolation forest and PCA reconstruction, thresholds and tiers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ranking import percentiles
from .forest import NODES, Forest, fit_forest, sorted_nodes
from .reconstruction import Reconstruction, fit_reconstruction
from .scaling import MinMax, Scaler, fit_min_max, fit_scaler

FOREST_WEIGHT, RECONSTRUCTION_WEIGHT = 0.4, 0.6
HIGH_FRACTION, MEDIUM_FRACTION = 0.99, 0.95


def ensemble_score(isolation: Column, reconstruction: Column) -> Column:
    return F.lit(FOREST_WEIGHT) * isolation + F.lit(RECONSTRUCTION_WEIGHT) * reconstruction


def alert_thresholds(df: DataFrame, score: str = "anomaly_score") -> tuple[float, float]:
    """99th and 95th percentile of the scores: (high, medium)."""
    high, medium = percentiles(df, F.col(score), [HIGH_FRACTION, MEDIUM_FRACTION])
    return high, medium


def tiers(df: DataFrame, high: float, medium: float, score: str = "anomaly_score", cutoff: float | None = None) -> DataFrame:
    s = F.col(score)
    tier = F.when(s >= high, "HIGH").when(s >= medium, "MEDIUM").otherwise("LOW")
    hit = F.when(s >= (medium if cutoff is None else cutoff), 1).otherwise(0).cast("bigint")
    return df.withColumns({"alert_tier": tier, "is_alert": hit})


@dataclass(frozen=True)
class Detector:
    scaler: Scaler
    forest: Forest
    reconstruction: Reconstruction
    forest_range: MinMax
    reconstruction_range: MinMax
    high: float
    medium: float

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly_score``, ``alert_tier`` and ``is_alert``, on the scale of the training scores."""
        out = _raw_scores(df, self.scaler, self.forest, self.reconstruction)
        out = _blend(out, self.forest_range, self.reconstruction_range)
        return tiers(out, self.high, self.medium)

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.nodes(spark).write.mode("overwrite").parquet(f"{path}/forest")
        meta = {
            "features": self.scaler.features, "means": self.scaler.means, "scales": self.scaler.scales,
            "components": self.reconstruction.components.tolist(),
            "forest_range": [self.forest_range.low, self.forest_range.high],
            "reconstruction_range": [self.reconstruction_range.low, self.reconstruction_range.high],
            "trees": self.forest.trees, "sample": self.forest.sample, "high": self.high, "medium": self.medium,
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_detector(spark: SparkSession, path: str) -> Detector:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    nodes = sorted_nodes(spark.read.schema(NODES).parquet(f"{path}/forest"))
    return Detector(
        Scaler(tuple(meta["features"]), tuple(meta["means"]), tuple(meta["scales"])),
        Forest(nodes, meta["trees"], meta["sample"]),
        Reconstruction(np.array(meta["components"])),
        MinMax(*meta["forest_range"]), MinMax(*meta["reconstruction_range"]),
        meta["high"], meta["medium"],
    )


def _raw_scores(df: DataFrame, scaler: Scaler, forest: Forest, reconstruction: Reconstruction) -> DataFrame:
    out = df.withColumn("_x", scaler.vector())
    out = forest.score(out, F.col("_x"))
    return reconstruction.score(out, F.col("_x")).drop("_x")


def _blend(df: DataFrame, forest_range: MinMax, reconstruction_range: MinMax) -> DataFrame:
    isolation = forest_range.apply(F.col("isolation_raw"), clamp=True)
    error = reconstruction_range.apply(F.col("reconstruction_raw"), clamp=True)
    return df.withColumn("anomaly_score", ensemble_score(isolation, error)).drop("isolation_raw", "reconstruction_raw")


def fit_detector(train: DataFrame, features: Sequence[str], trees: int = 150, seed: int = 42) -> Detector:
    """Fit on engineered training rows. The training scores are computed once and kept for the thresholds."""
    scaler = fit_scaler(train, features)
    vector = scaler.vector()
    forest = fit_forest(train, vector, trees=trees, seed=seed)
    reconstruction = fit_reconstruction(train, vector, len(features))
    raw = _raw_scores(train.select("event_id", *features), scaler, forest, reconstruction).select(
        "event_id", "isolation_raw", "reconstruction_raw"
    ).persist()
    try:
        forest_range, reconstruction_range = fit_min_max(raw, "isolation_raw", "reconstruction_raw")
        high, medium = alert_thresholds(_blend(raw, forest_range, reconstruction_range))
    finally:
        raw.unpersist()
    return Detector(scaler, forest, reconstruction, forest_range, reconstruction_range, high, medium)
