import numpy as np
from pyspark.sql import functions as F

from wardenlog.operators import boosting as B


def _table(spark, n):
    a, b = ((F.xxhash64("id", F.lit(i)) % 1000 / 1000).alias(c) for i, c in enumerate("ab"))
    return spark.range(n).select(F.col("id").alias("event_id"), a, b).withColumn(
        "attack_type", F.when(F.col("a") > 0.2, "x").when(F.col("b") > 0, "y").otherwise("z"))


def test_tasks_that_share_the_classes_grow_the_same_trees(spark, monkeypatch):
    table = _table(spark, 3000)
    one = B.fit(table, ["a", "b"], rounds=3, depth=3)
    monkeypatch.setattr(B, "BARRIER_ROWS", 100, raising=False)
    shared = []
    monkeypatch.setattr(B, "to_each_task", lambda t, n, f=B.to_each_task: shared.append(n) or f(t, n))
    many = B.fit(table, ["a", "b"], rounds=3, depth=3)
    assert shared == [3] and (one.gains == many.gains).all()
    for a, b in zip(one.rounds, many.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.column == t.column).all() and (s.bin == t.bin).all() and (s.value == t.value).all()


def test_150000_rows_need_no_job_for_each_level(spark):
    spark.sparkContext.setJobGroup("boosting-jobs", "")
    B.fit(_table(spark, 150_000), ["a", "b"], rounds=8, depth=3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20


def test_leaves_of_any_level(spark):
    tree = B.Tree(np.array([1, -1, 0, -1, -1, -1, -1]), np.array([5, 0, 9, 0, 0, 0, 0]), np.array([0.0, 1.5, 0.0, 7.0, 7.0, 2.5, 3.5]))
    bins = np.array([[0, 5], [63, 0], [9, 6], [10, 6]], np.uint8)
    assert tree.leaves(bins).tolist() == [1.5, 1.5, 2.5, 3.5]
