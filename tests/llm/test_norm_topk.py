import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlog.llm import norm_topk as T

SCHEMA = "vec_id bigint, embedding array<double>, score string, dim string"


def brute(rows, k):
    taken = []
    for r, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            taken.append((r, i, [math.floor(256 * x) for x in v]))
    out = []
    for r, i, q in taken:
        if i is not None and math.fmod(i, 50) == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for s, j, v in taken if s != r and len(v) == len(q))
            out += [(i, n, None if null else j, max(-2**63, min(2**63 - 1, -s))) for n, (s, null, j) in enumerate(near[:k], 1)]
    return sorted(map(str, out))


def found(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    made = T.search(df.repartition(3), F.col("vec_id") % 50 == 0, k, **more)
    return sorted(str((r.query_id, r.rank, r.vec_id, r.score)) for r in made.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        v = rng.normal(size=24)
        if i % 3 == 0:  # near copies of a few directions
            v = np.eye(24)[i % 5] * 4 + 0.05 * v
        rows.append((i, (v * rng.lognormal(0, 1.2)).tolist()))
    rows += [(i, [0.5] * 24) for i in range(2000, 2400)]  # one vector many times
    return rows


def test_same_as_brute_force(spark, clustered, monkeypatch):
    monkeypatch.setattr(T, "MOST_ROWS", 64)
    assert found(spark, clustered, span=2) == brute(clustered, 5)


def test_every_way_of_pruning_is_taken(clustered, monkeypatch):
    def packed(rows):
        rows = sorted(([np.floor(256 * np.array(v)), i] for i, v in rows), key=lambda r: -(r[0] @ r[0]))
        held = [(i, 1, 24, float((v @ v) ** 0.5), float(np.abs(v).max()), v.astype("<f8").tobytes() if np.abs(v).max() >= 32768 else v.astype("<i2").tobytes(), i)
                for v, i in rows]
        return [T.Vectors(T.packed(held[n:n + 100], 0, n)) for n in range(0, len(held), 100)]

    buckets = packed(clustered)
    search = T.Search(packed([r for r in clustered if r[0] % 50 == 0])[0], 5)
    whole = near = pruned = 0
    for b in buckets:
        local = search.needed() / b.longest
        live = np.nonzero(local <= 1)[0]
        chosen = search.near_coordinates(b, local, live)
        pruned, near, whole = pruned + len(local) - len(live), near + len(chosen), whole + len(live) - len(chosen)
        search.meet(b)
    assert pruned and near and whole


def test_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [(50, [0.1, 0.2, 0.3]), (50, [0.1, 0.2, 0.3]), (None, [9.0, 9.0, 9.0]), (None, None), (100, None), (150, [1.0, None, 2.0]),
             (200, [math.nan, 1.0, 1.0]), (250, [math.inf, 0.0, 0.0]), (300, []), (301, []), (350, [1.0]), (400, [0.0, 0.0, 0.0]), (-50, [1.0, 0.0, -1.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, []) == []


def test_products_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2**50 + i), float(i), -3.5]) for i in range(0, 120)] + [(500 + i, [1e20 + i * 1e6, 2.0, 0.0]) for i in range(8)]
    assert found(spark, rows) == brute(rows, 5)
