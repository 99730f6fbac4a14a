import math

import numpy as np
import pytest

from wardenlog.operators import boosting as B


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        a, b, c = rng.normal(size=3)
        kind = "x" if a > 0.3 and b < 0.5 else "y" if c * a > 0.1 else "z"
        rows.append((i, float(a), float(b), None if i % 50 == 0 else float(c), math.nan if i % 60 == 0 else 1.0, kind if i % 100 else None))
    return spark.createDataFrame(rows, "event_id int, a double, b double, c double, d double, attack_type string")


FEATURES = ["a", "b", "c", "d"]


def test_learns_and_walks(spark, table):
    model = B.fit(table, FEATURES, rounds=25, depth=4)
    got = model.predict(table)
    right = got.where("attack_type = predicted_attack").count() / table.where("attack_type IS NOT NULL").count()
    assert model.classes == ["x", "y", "z"] and right > 0.95 and len(model.rounds) == 25
    assert got.where("classifier_confidence < 1/3 or classifier_confidence > 1").count() == 0
    assert abs(sum(model.importances()) - 1) < 1e-9 and model.importances()[3] == 0
    # The stored trees, walked by hand, give the same margins.
    nodes = {(r["round"], r["class"], r["node"]): r for r in model.nodes(spark).collect()}
    for row in got.limit(40).collect():
        margins = []
        for name in model.classes:
            total = 0.0
            for r in range(25):
                n = 0
                while (node := nodes[r, name, n])["feature"] is not None:
                    v = row[node["feature"]]
                    n = 2 * n + 1 + ((0.0 if v is None or v != v else v) > node["threshold"])
                total += node["value"]
            margins.append(total)
        assert model.classes[int(np.argmax(margins))] == row.predicted_attack


def test_many_tasks_grow_the_same_trees(spark, table):
    one = B.fit(table, FEATURES, rounds=12, depth=3)
    many = B.fit(table.repartition(5), FEATURES, rounds=12, depth=3, rows_per_task=300)
    for a, b in zip(one.rounds, many.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.column == t.column).all() and (s.bin == t.bin).all() and np.allclose(s.value, t.value)


def test_first_round_is_exact(spark):
    # Two classes, one column: sums of the first split by hand.
    rows = [(i, float(i), "p" if i < 12 else "q") for i in range(40)]
    model = B.fit(spark.createDataFrame(rows, "event_id int, v double, attack_type string"), ["v"], rounds=1, depth=1, subsample=1.0, columns=1.0)
    tree = model.rounds[0][0]
    assert model.cuts[0][tree.bin[0]] == 11.0
    assert tree.value[1] == pytest.approx(12 * 0.5 / (12 * 0.5 + 1)) and tree.value[2] == pytest.approx(-28 * 0.5 / (28 * 0.5 + 1))


def test_save_and_load(spark, table, tmp_path):
    model = B.fit(table, FEATURES, rounds=3, depth=2)
    model.save(spark, str(tmp_path / "m"))
    again = B.load(spark, str(tmp_path / "m"))
    a, b = ([(r.event_id, r.predicted_attack, r.classifier_confidence) for r in m.predict(table).orderBy("event_id").collect()] for m in (model, again))
    assert a == b


def test_odd_tables(spark, table):
    none = B.fit(table.limit(0), FEATURES)
    assert none.classes == [] and none.predict(table).where("predicted_attack IS NOT NULL").count() == 0
    one = B.fit(table.where("attack_type = 'x'"), FEATURES, rounds=2)
    assert {r.predicted_attack for r in one.predict(table).collect()} == {"x"}
