"""Isolation forest: Spark samples rows per tree, grows the trees in parallel and scores in Arrow batches.

A tree sees at most ``SAMPLE`` rows, as the method defines, so growing it is a small task; the whole forest is at
most trees x (2 * SAMPLE - 1) nodes, which bounds what the scoring tasks receive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

SAMPLE = 256
#: Rows that walk the trees together: what they stand at then stays in the processor's cache.
BLOCK = 256
NODES = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("depth", T.DoubleType()),
    T.StructField("rows", T.LongType()),
])


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(seed: int):
    # Captured as plain values, so that workers need nothing but numpy and pandas.
    path_of = [average_path(n) for n in range(SAMPLE + 1)]
    names = list(NODES.names)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # Sorted by id: the order in which rows arrive must not matter.
        x = np.array(rows.sort_values("id")["x"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        limit = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes: list[list] = []
        todo = [(np.arange(len(x)), 0, None)]
        while todo:
            idx, depth, parent = todo.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = me
            part = x[idx]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
            if depth >= limit or len(idx) <= 1 or len(spread) == 0:
                nodes.append([tree, me, -1, 0.0, -1, -1, depth + path_of[len(idx)], len(idx)])
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            nodes.append([tree, me, f, cut, -1, -1, float(depth), len(idx)])
            below = part[:, f] <= cut
            todo.append((idx[~below], depth + 1, (me, 5)))
            todo.append((idx[below], depth + 1, (me, 4)))
        return pd.DataFrame(nodes, columns=names)

    return grow


def sample_rows(df: DataFrame, id_column: str, vector, trees: int, seed: int, n: int) -> DataFrame:
    """Up to ``SAMPLE`` uniformly chosen rows of all rows per tree, by seeded hashes of the row id.

    A row enters a tree's candidates with probability 3 * SAMPLE / n. A first hash keeps as many rows as all trees
    expect together, so that only those are hashed again for each tree; no row is left out beforehand.
    """
    # All 64 bits count: of very many rows, coarse steps would tie.
    def unit(*of) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)

    row_hash = unit(F.col(id_column), F.lit(seed))
    pool = df.select(F.col(id_column).alias("id"), vector.alias("x"), row_hash.alias("_h"))
    wanted = 3.0 * SAMPLE / max(n, 1)
    share = min(1.0, trees * wanted)
    if share < 1.0:
        pool = pool.where(F.col("_h") < share)
    per_tree = min(1.0, wanted / share)
    picks = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"),
            unit(F.col("id"), F.lit(seed), t).alias("u"))),
        lambda p: p["u"] < per_tree,
    )
    chosen = pool.select("id", "x", F.explode(picks).alias("_p")).select("id", "x", "_p.tree", "_p.u")
    # About 3 * SAMPLE candidates per tree remain.
    order = W.partitionBy("tree").orderBy("u", "id")
    return chosen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE).select("tree", "id", "x")


@dataclass(frozen=True)
class Forest:
    """The nodes of all trees: a bounded table, held locally so that every use sees the same forest."""

    table: pd.DataFrame
    trees: int
    sample: int

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.table, NODES)

    def score(self, df: DataFrame, vector, name: str = "isolation_raw") -> DataFrame:
        """Adds the isolation score 2^(-E[path] / c(sample)); higher is more anomalous."""
        table = self.table
        start = table.groupby("tree").size().reindex(range(self.trees), fill_value=0).cumsum().shift(1, fill_value=0)
        offset = table["tree"].map(start).to_numpy()
        feature, cut = table["feature"].to_numpy(), table["threshold"].to_numpy()
        left = np.where(feature >= 0, table["left"] + offset, np.arange(len(table)))
        right = np.where(feature >= 0, table["right"] + offset, np.arange(len(table)))
        roots = start[sorted(table["tree"].unique())].to_numpy().astype(np.int64)
        shared = df.sparkSession.sparkContext.broadcast(
            (np.maximum(feature, 0).astype(np.int64), cut, np.stack([right, left], axis=1).astype(np.int64).ravel(), table["depth"].to_numpy(), roots)
        )
        norm = average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolation(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            column, cut, children, depth, roots = shared.value
            steps = int(math.ceil(math.log2(SAMPLE))) + 1
            for batch in batches:
                x = np.array(batch.tolist(), dtype=float)
                path = np.zeros(len(x))
                for first in range(0, len(x), BLOCK):
                    part = x[first:first + BLOCK]
                    flat, row = part.ravel(), (np.arange(len(part)) * x.shape[1])[:, None]
                    at = np.tile(roots, (len(part), 1))
                    for _ in range(steps):
                        below = flat.take(row + column.take(at)) <= cut.take(at)
                        at = children.take(2 * at + below)
                    path[first:first + BLOCK] = depth.take(at).mean(axis=1)
                yield pd.Series(np.power(2.0, -path / norm))

        return df.withColumn(name, isolation(vector))


def fit_forest(df: DataFrame, vector, id_column: str = "event_id", trees: int = 150, seed: int = 42) -> Forest:
    n = df.count()
    rows = sample_rows(df, id_column, vector, trees, seed, n)
    nodes = rows.groupBy("tree").applyInPandas(_grow(seed), NODES)
    return Forest(sorted_nodes(nodes), trees, min(SAMPLE, n))


def sorted_nodes(nodes: DataFrame) -> pd.DataFrame:
    return nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
