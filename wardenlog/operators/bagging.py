"""Random forest whose trees are grown by tasks and kept in a table: for more training rows than a driver can hold the trees of.

As in Spark ML's forest: a tree trains on a Poisson(1) bootstrap of the rows, each node draws the root of the number of columns,
columns have BINS bins at quantiles, splits are chosen by Gini impurity, and the class shares of the leaves are averaged.
A tree's task holds all training rows, one byte for each column of a row and about 40 bytes more; the driver sees neither rows
nor, of the trees, more than PART at a time. Weights and draws follow hashes of rows and numbers of nodes, and counts are whole,
so for the same bins any dealing of the rows gives the same trees.

Defined cases: null and NaN features count as zero; rows without a class do not train; ties of splits go to the first column and bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import written
from .copies import packed_rows, slots, to_each_task, unpacked

#: Bins of a column; trees of one broadcast; cells of a histogram that are looked at together; rows that walk together.
BINS, PART, CELLS, BLOCK = 32, 10, 1 << 20, 1 << 12
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_TREES = "tree int, nodes binary, leaf binary, counts binary, wide boolean, importance array<double>"


def _value(f: str) -> Column:
    return F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))


def _binned(cuts: Sequence[np.ndarray], columns: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(columns[0]), len(columns)), np.uint8)
    for j, x in enumerate(columns):
        out[:, j] = np.searchsorted(cuts[j], x, "left")
    return out


def _walk(nodes: np.ndarray, bins: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Node where each row ends. A node is one number: left child, bin, column; the right child follows; a leaf is its own left child."""
    at = np.zeros(len(rows), np.int64)
    for _ in range(depth):
        node = nodes.take(at)
        at = (node >> 24) + (bins.take(rows + (node & 0xFFFF)) > ((node >> 16) & 0xFF))
    return at


def _weights(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53), "right")


def _grow(bins: np.ndarray, y: np.ndarray, key: np.ndarray, classes: int, depth: int, seed: int, tree: int) -> tuple:
    """Nodes, number of each leaf, class counts of the leaves, importance of the columns."""
    width = bins.shape[1]
    flat, some = bins.ravel(), max(1, math.ceil(math.sqrt(width)))
    weight = _weights(key, seed, tree)
    rows = np.nonzero(weight)[0]
    w, c, base, slot = weight[rows].astype(np.float64), y[rows], rows * width, np.zeros(len(rows), np.uint16)
    levels, leaves, importance, made = [], [], np.zeros(width), 0
    open_nodes = 1
    for level in range(depth + 1):
        counts = np.bincount(slot.astype(np.int64) * classes + c, w, open_nodes * classes).reshape(open_nodes, classes)
        total, own = counts.sum(axis=1), (counts ** 2).sum(axis=1)
        column, cut = np.full(open_nodes, -1), np.zeros(open_nodes, np.int64)
        tried = np.nonzero((counts > 0).sum(axis=1) > 1)[0] if level < depth else np.zeros(0, np.int64)
        if len(tried):
            rng = np.random.default_rng([seed, tree, level])
            drawn = np.sort(rng.random((open_nodes, width)).argpartition(some - 1, axis=1)[:, :some], axis=1)
            # Rows by node; slots have 16 bits, so this is a radix sort.
            order = np.argsort(slot, kind="stable")
            w, c, base, slot = w[order], c[order], base[order], slot[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=open_nodes))])
            step = max(1, CELLS // (some * BINS * classes))
            for first in range(0, open_nodes, step):
                last = min(first + step, open_nodes)
                n, part = last - first, slice(ends[first], ends[last])
                mine = slot[part].astype(np.int64)
                sums = np.zeros(n * some * BINS * classes)
                for at in range(0, len(mine), CELLS):
                    few = slice(part.start + at, min(part.start + at + CELLS, part.stop))
                    for s in range(some):
                        cell = ((mine[at:at + CELLS] - first) * some + s) * BINS + flat.take(base[few] + drawn[mine[at:at + CELLS], s])
                        sums += np.bincount(cell * classes + c[few], w[few], len(sums))
                left = sums.reshape(n, some, BINS, classes)[:, :, :-1].cumsum(axis=2)
                right = counts[first:last, None, None] - left
                in_left, in_right = left.sum(axis=3), right.sum(axis=3)
                score = (left ** 2).sum(axis=3) / np.maximum(in_left, 1) + (right ** 2).sum(axis=3) / np.maximum(in_right, 1)
                score[(in_left == 0) | (in_right == 0)] = -np.inf
                score = score.reshape(n, -1)
                best = score.argmax(axis=1)
                gain = score[np.arange(n), best] - own[first:last] / total[first:last]
                good = gain > 1e-9
                column[first:last] = np.where(good, drawn[np.arange(first, last), best // (BINS - 1)], -1)
                cut[first:last] = best % (BINS - 1)
                importance += np.bincount(column[first:last][good], gain[good], width)
        inner = column >= 0
        number = np.cumsum(inner) - 1
        here = made + np.arange(open_nodes)
        made += open_nodes
        levels.append(np.where(inner, (made + 2 * number) << 24 | cut << 16 | np.maximum(column, 0), here << 24 | 0xFF << 16))
        leaves.append(np.where(inner[:, None], 0, counts))
        if not inner.any():
            break
        keep = np.nonzero(inner[slot])[0]
        w, c, base, mine = w[keep], c[keep], base[keep], slot[keep]
        slot = (2 * number[mine] + (flat.take(base + column[mine]) > cut[mine])).astype(np.uint16)
        open_nodes = 2 * int(inner.sum())
    nodes, counts = np.concatenate(levels), np.concatenate(leaves)
    is_leaf = counts.any(axis=1)
    spread = importance.sum()
    return nodes, np.cumsum(is_leaf) - 1, counts[is_leaf], importance / spread if spread else importance


@dataclass
class Bagged:
    features: list[str]
    classes: list[str]
    cuts: list[np.ndarray]
    depth: int
    trees: int
    table: DataFrame
    _parts: list[Broadcast] = field(default_factory=list)

    def _shared(self) -> list[Broadcast]:
        if not self._parts:
            for first in range(0, self.trees, PART):
                rows = self.table.where(F.col("tree").between(first, first + PART - 1)).orderBy("tree").collect()
                self._parts.append(self.table.sparkSession.sparkContext.broadcast([tuple(r)[1:5] for r in rows]))
        return self._parts

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted_attack`` and ``classifier_confidence`` (largest class probability)."""
        shared, cuts, classes, depth, trees = self._shared(), self.cuts, self.classes, self.depth, self.trees

        @F.pandas_udf("classifier_confidence double, predicted_attack string")
        def named(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            forest = [(np.frombuffer(nodes, np.int64), np.frombuffer(leaf, np.int32), np.frombuffer(counts, np.int32 if wide else np.uint16).reshape(-1, len(classes)))
                      for part in shared for nodes, leaf, counts, wide in part.value]
            for batch in batches:
                bins = _binned(cuts, [s.to_numpy() for s in batch])
                p = np.zeros((len(bins), len(classes)))
                for first in range(0, len(bins), BLOCK):
                    block = bins[first:first + BLOCK].ravel()
                    rows = np.arange(len(block) // len(cuts)) * len(cuts)
                    for nodes, leaf, counts in forest:
                        found = counts.take(leaf.take(_walk(nodes, block, rows, depth)), axis=0)
                        p[first:first + BLOCK] += found / found.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                yield pd.DataFrame({"classifier_confidence": p[np.arange(len(p)), best] / trees, "predicted_attack": np.array(classes, object)[best]})

        out = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features}).withColumn("_named", named(*map(_value, self.features)))
        return out.withColumns({c: F.col(f"_named.{c}") for c in ("classifier_confidence", "predicted_attack")}).drop("_named")

    def importances(self) -> list[float]:
        rows = self.table.select("importance").orderBy("tree").collect()
        total = np.sum([r[0] for r in rows], axis=0)
        return [float(v) for v in (total / total.sum() if total.sum() else total)]

    def top_features(self, spark: SparkSession, n: int = 10) -> DataFrame:
        from .classifier import top_features

        return top_features(spark, self, n)

    def save(self, path: str) -> None:
        meta = json.dumps({"features": self.features, "classes": self.classes, "cuts": [c.tolist() for c in self.cuts], "depth": self.depth, "trees": self.trees})
        self.table.write.mode("overwrite").parquet(f"{path}/trees")
        self.table.sparkSession.createDataFrame([(meta,)], "model string").write.mode("overwrite").parquet(f"{path}/forest")


def load(spark: SparkSession, path: str) -> Bagged:
    m = json.loads(spark.read.parquet(f"{path}/forest").first()["model"])
    return Bagged(m["features"], m["classes"], [np.array(c) for c in m["cuts"]], m["depth"], m["trees"], spark.read.schema(_TREES).parquet(f"{path}/trees"))


def fit(train: DataFrame, features: Sequence[str], target: str, key: Sequence[str], trees: int = 150, depth: int = 15, seed: int = 42) -> Bagged:
    """Forest for the classes of ``target``, in the order of their names. Rows that agree in ``key`` and features are drawn alike."""
    features, train = list(features), train.where(F.col(target).isNotNull())
    classes = sorted(r[0] for r in train.select(target).distinct().collect())
    rows = train.select((F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1).alias("y"), F.xxhash64(*key, target, *features).alias("key"),
                        *(_value(f).alias(f) for f in features))
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(f, shares, 200 * BINS).alias(f) for f in features)).first()
    cuts, width, k = [np.unique(np.array(found[f], np.float64)) for f in features], len(features), len(classes)

    def packed(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)), _binned(cuts, [np.asarray(batch.column(2 + j)) for j in range(width)])]

    spark = train.sparkSession
    tasks = min(trees, 2 * slots(spark))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        y, keys, bins = unpacked(batches, [(np.int64, 1), (np.int64, 1), (np.uint8, width)])
        for tree in range(TaskContext.get().partitionId(), trees, tasks):
            nodes, leaf, counts, importance = _grow(bins, y[:, 0], keys[:, 0], k, depth, seed, tree)
            wide = bool(counts.max(initial=0) >= 1 << 16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([nodes.astype(np.int64).tobytes()]), pa.array([leaf.astype(np.int32).tobytes()]),
                 pa.array([counts.astype(np.int32 if wide else np.uint16).tobytes()]), pa.array([wide]), pa.array([importance.tolist()], pa.list_(pa.float64()))],
                ["tree", "nodes", "leaf", "counts", "wide", "importance"])

    blocks = written(packed_rows(rows, packed), "training-rows")
    return Bagged(features, classes, cuts, depth, trees, written(to_each_task(blocks, tasks).mapInArrow(grown, _TREES), "trees"))
