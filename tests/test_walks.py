import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardenlog.operators import forest
from wardenlog.plans.catalog import models


def test_rows_walk_numbered_nodes(spark):
    nodes = spark.createDataFrame(
        [(0, 1, 0.5, 1, 2, 9.0), (1, 0, 0.0, 1, 1, 1.0), (2, 0, 3.0, 3, 4, 9.0), (3, 0, 0.0, 3, 3, 2.0), (4, 0, 0.0, 4, 4, 3.0)],
        "node bigint, feature int, threshold double, left bigint, right bigint, value double")
    walk = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [3.0, 1.0]), ("c", [4.0, 1.0])], "event_id string, x array<double>").withColumn("node", F.lit(0).cast("bigint"))
    got = {r["event_id"]: r["value"] for r in models._walked(walk, nodes, 3, ["event_id"], "value").collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_forest_scores_of_blocks(spark):
    table = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 0.0, 3), (0, 1, -1, 0.0, -1, -1, 1.0, 2), (0, 2, -1, 0.0, -1, -1, 3.0, 1), (1, 0, -1, 0.0, -1, -1, 2.0, 1)],
                         columns=forest.NODES.names)
    rows = spark.range(700).select("id", F.array((F.col("id") % 2).cast("double")).alias("x"))
    scores = forest.Forest(table, 2, 3).score(rows, F.col("x")).toPandas().set_index("id")["isolation_raw"]
    norm = forest.average_path(3)
    assert scores.to_numpy() == pytest.approx(np.where(np.arange(700) % 2 == 0, 2 ** (-1.5 / norm), 2 ** (-2.5 / norm)))
