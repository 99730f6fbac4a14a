import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlog.operators import bagging, classifier


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        a, b, c = rng.normal(size=3)
        kind = "x" if a > 0.3 and b < 0.5 else "y" if c * a > 0.1 else "z"
        rows.append((i, "anomaly", float(a), float(b), None if i % 50 == 0 else float(c), math.nan if i % 60 == 0 else 1.0, kind if i % 100 else None))
    return spark.createDataFrame(rows, "event_id int, label string, a double, b double, c double, d double, attack_type string")


FEATURES = ["a", "b", "c", "d"]


def rows_of(df):
    return [tuple(r) for r in df.select("event_id", "predicted_attack", "classifier_confidence").orderBy("event_id").collect()]


def test_learns_and_any_dealing_gives_the_same_trees(spark, table):
    model = bagging.fit(table, FEATURES, "attack_type", ["event_id"], trees=40, depth=8)
    got = model.predict(table)
    right = got.where("attack_type = predicted_attack").count() / table.where("attack_type IS NOT NULL").count()
    assert model.classes == ["x", "y", "z"] and right > 0.95
    assert got.where("classifier_confidence < 1/3 or classifier_confidence > 1 + 1e-9").count() == 0
    assert sum(model.importances()) == pytest.approx(1) and model.importances()[3] < min(model.importances()[:3])
    again = bagging.fit(table.repartition(7), FEATURES, "attack_type", ["event_id"], trees=40, depth=8)
    assert rows_of(again.predict(table)) == rows_of(got)


def test_leaves_hold_the_whole_bootstrap(spark, table):
    model = bagging.fit(table, FEATURES, "attack_type", ["event_id"], trees=3, depth=15)
    sizes = [int(np.frombuffer(r["counts"], np.uint16).sum()) for r in model.table.collect()]
    n = table.where("attack_type IS NOT NULL").count()
    assert all(abs(s - n) < 5 * math.sqrt(n) for s in sizes) and len(set(sizes)) > 1


def test_many_rows_leave_no_trees_in_the_driver(spark, table, monkeypatch, tmp_path):
    monkeypatch.setattr(classifier, "FOREST_ROWS", 1000, raising=False)
    model = classifier.fit_classifier(table, FEATURES, classifier.random_forest(trees=20, depth=6))
    assert isinstance(model, bagging.Bagged) and model.trees == 20 and model.depth == 6
    model.save(str(tmp_path / "m"))
    again = classifier.load_classifier(str(tmp_path / "m"))
    assert rows_of(again.predict(table)) == rows_of(model.predict(table))
    assert [r[0] for r in model.top_features(spark, 4).collect()] == [r[0] for r in again.top_features(spark, 4).collect()]


def test_one_class_and_nulls(spark, table):
    one = bagging.fit(table.where("attack_type = 'x'"), FEATURES, "attack_type", [], trees=2)
    got = one.predict(table.withColumn("a", F.lit(None).cast("double")))
    assert {tuple(r) for r in got.select("predicted_attack", "classifier_confidence").distinct().collect()} == {("x", 1.0)}
