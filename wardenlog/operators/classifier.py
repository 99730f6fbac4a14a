"""Attack classification: training, prediction, comparison, importances, records.

Forests of up to FOREST_ROWS training rows are Spark ML's, whose driver holds all trees; those of more are grown and kept by tasks.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.columns import lookup, pretty_attack
from . import bagging, boosting
from .evaluate import multiclass_metrics


#: Rows of a training task; rows up to which the driver holds the forest.
ROWS_PER_TASK, FOREST_ROWS = 50_000, 5_000


def random_forest(trees: int = 150, depth: int = 15, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=512
    )


@dataclass
class BoostedTrees:
    """Settings of a multiclass boosted model."""

    rounds: int = 150
    depth: int = 6
    seed: int = 42


def boosted_trees(rounds: int = 150, depth: int = 6, seed: int = 42) -> BoostedTrees:
    return BoostedTrees(rounds, depth, seed)


def label_indexer(column: str = "attack_type") -> StringIndexer:
    """Codes in sorted order of the class names; rows of unseen classes are kept with an extra code."""
    return StringIndexer(inputCol=column, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


@dataclass
class AttackClassifier:
    model: PipelineModel
    features: list[str]
    classes: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted_attack`` and ``classifier_confidence`` (largest class probability)."""
        scored = self.model.transform(filled(df, self.features))
        probability = vector_to_array("probability")
        names = F.array(*[F.lit(c) for c in self.classes])
        # The code kept for unseen classes is not a class.
        scored = scored.withColumn("_p", F.slice(probability, 1, len(self.classes)))
        best = F.array_max("_p")
        return scored.withColumns({
            "classifier_confidence": best,
            "predicted_attack": F.element_at(names, F.array_position("_p", best).cast("int")),
        }).drop("x", "y", "rawPrediction", "probability", "prediction", "_p")

    def importances(self) -> list[float]:
        return [float(v) for v in self.model.stages[-1].featureImportances.toArray()]

    def top_features(self, spark: SparkSession, n: int = 10) -> DataFrame:
        return top_features(spark, self, n)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")


def top_features(spark: SparkSession, fitted: AttackClassifier | boosting.Boosted, n: int = 10) -> DataFrame:
    table = spark.createDataFrame(list(zip(fitted.features, fitted.importances())), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def load_classifier(path: str) -> AttackClassifier | bagging.Bagged:
    spark = SparkSession.active()
    of_tasks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/forest")
    if of_tasks.getFileSystem(spark._jsc.hadoopConfiguration()).exists(of_tasks):
        return bagging.load(spark, path)
    model = PipelineModel.load(f"{path}/model")
    indexer = next(s for s in model.stages if hasattr(s, "labels"))
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return AttackClassifier(model, assembler.getInputCols(), list(indexer.labels))


def fit_classifier(train: DataFrame, features: Sequence[str], estimator=None, target: str = "attack_type") -> AttackClassifier | bagging.Bagged | boosting.Boosted:
    """Train on the anomalies of ``train``; the classifier never predicts ``normal`` unless it is among them."""
    if isinstance(estimator, BoostedTrees):
        anomalies = train.where(F.col("label") == "anomaly").select("event_id", target, *features)
        return boosting.fit(anomalies, features, target, rounds=estimator.rounds, depth=estimator.depth, seed=estimator.seed)
    estimator, anomalies = estimator or random_forest(), train.where(F.col("label") == "anomaly")
    if isinstance(estimator, RandomForestClassifier) and anomalies.count() > FOREST_ROWS:
        key = [c for c in ("event_id",) if c in train.columns]
        return bagging.fit(anomalies, features, target, key, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed())
    rows = filled(anomalies.select(target, *features), features).persist()
    # Anomalies are few among many rows; training runs many short jobs over them, so their tasks should not be smaller than need be.
    dealt = rows.repartition(-(-max(rows.count(), 1) // ROWS_PER_TASK))
    assembler = VectorAssembler(inputCols=list(features), outputCol="x")
    pipeline = Pipeline(stages=[label_indexer(target).setHandleInvalid("skip"), assembler, estimator])
    model = pipeline.fit(dealt)
    rows.unpersist()
    # At prediction time the true class may be unknown; it is not needed.
    model.stages[0].setHandleInvalid("keep")
    return AttackClassifier(model, list(features), list(model.stages[0].labels))


def compare(
    train: DataFrame, test: DataFrame, features: Sequence[str], candidates: dict[str, object]
) -> tuple[DataFrame, str]:
    """Fit every candidate; metrics on the test anomalies, best F1 first. Returns the table and the winner."""
    spark = train.sparkSession
    columns = ["event_id", "label", "attack_type", *features]
    # Only anomalies train.
    fit_rows, held = train.where(F.col("label") == "anomaly").select(columns).persist(), test.where(F.col("label") == "anomaly").select(columns).persist()
    rows = []
    try:
        n = held.count()
        for name, estimator in candidates.items():
            t0 = time.perf_counter()
            fitted = fit_classifier(fit_rows, features, estimator)
            t1 = time.perf_counter()
            m = multiclass_metrics(fitted.predict(held), "attack_type", "predicted_attack").first()
            t2 = time.perf_counter()
            rows.append((
                name, *[round(float(m[c] or 0.0), 4) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")],
                t1 - t0, (t2 - t1) / max(n, 1) * 1000.0,
            ))
    finally:
        fit_rows.unpersist()
        held.unpersist()
    schema = ("model string, accuracy double, weighted_precision double, weighted_recall double, weighted_f1 double, "
              "train_seconds double, inference_ms_per_row double")
    winner = max(rows, key=lambda r: r[4])[0]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("weighted_f1"), "model"), winner


def severity(attack: Column, confidence: Column) -> Column:
    base = lookup(attack, V.ATTACK_SEVERITY, V.ATTACK_SEVERITY_DEFAULT)
    return F.when((confidence > 0.90) & (base == "High"), "Critical").otherwise(base)


def prominent_features(top: Sequence[str], k: int = 3, present: Sequence[str] | None = None) -> Column:
    """Of the global top features those that are active in the row first, filled up to ``k``."""
    def value(f):
        return F.abs(F.col(f).cast("double")) if present is None or f in present else F.lit(0.0)

    flags = F.array(*[
        F.struct(F.coalesce(value(f) > 0.01, F.lit(False)).alias("on"), F.lit(f).alias("f")) for f in top
    ])
    on = F.filter(flags, lambda s: s["on"])
    off = F.filter(flags, lambda s: ~s["on"])
    return F.slice(F.transform(F.concat(on, off), lambda s: s["f"]), 1, k)


def inference_records(df: DataFrame, top: Sequence[str]) -> DataFrame:
    """Record per predicted row: attack name, confidence, severity, leading features."""
    return df.select(
        "event_id", pretty_attack("predicted_attack").alias("attack_type"),
        F.round("classifier_confidence", 4).alias("confidence"),
        severity(F.col("predicted_attack"), F.col("classifier_confidence")).alias("severity"),
        prominent_features(top, present=df.columns).alias("top_features"),
    )
