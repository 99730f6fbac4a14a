"""Multiclass gradient boosting over histograms: softmax loss, one tree for each class in a round.

Columns are binned once at quantiles of the training rows. A level of a round's trees needs, for each class and open node,
the sums of gradients and second derivatives by column and bin. Tasks make these histograms from their rows by numpy, Spark adds
them by class and node, and the best split of each node, one row, comes back. All classes share a pass.

Rows that fit one task (ROWS_PER_TASK, about 160 bytes each) need no pass over a table for each level: one task holds them all. Of
more than BARRIER_ROWS, as many tasks as there are classes and cores do, each grows the trees of its classes, and they tell each other
the trees of a round, a few kilobytes, at a barrier. A barrier waits for about a second, which fewer rows are not worth. Sums are
fixed-point, so all ways, and any dealing of the rows, give the same trees.

Of more rows, margins are kept in a written table that is renewed every RENEW rounds; between, tasks add the trees since.

Defined cases: null and NaN features count as zero; rows without a class do not train; ties of splits go to the first column and bin;
one class gives trees without splits; an empty table gives a model without classes, which predicts null.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import written
from .copies import packed_rows, slots, to_each_task, unpacked

#: Sums of as many rows are exact as doubles: each is below 2^31.
BINS, ROWS_PER_TASK, RENEW = 64, 2_000_000, 10
#: Rows from which several tasks grow the classes; rows that are handled together.
BARRIER_ROWS, BLOCK = 300_000, 1 << 15
#: Strength of the penalty on leaf values, least sum of second derivatives in a child, unit of the sums.
PENALTY, LEAST_WEIGHT, UNIT = 1.0, 1.0, 1.0 / (1 << 30)


@dataclass
class Tree:
    """Nodes by number: the children of n are 2n + 1 and 2n + 2. Column -1 is a leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Value of each row's leaf. Leaves hand their value down to the lowest level on the left, so all rows walk as far."""
        column, cut, value = np.maximum(self.column, 0), np.where(self.column >= 0, self.bin, 255), self.value.copy()
        inner = len(column) // 2
        for n in np.nonzero(self.column[:inner] < 0)[0]:
            value[2 * n + 1] = value[n]
        flat, width, out = np.ascontiguousarray(bins).ravel(), bins.shape[1], np.empty(len(bins))
        if not width:
            return np.full(len(bins), self.value[0])
        for first in range(0, len(bins), BLOCK):
            row = np.arange(first, min(first + BLOCK, len(bins))) * width
            at = np.zeros(len(row), np.int64)
            for _ in range(int(np.log2(len(column) + 1)) - 1):
                at = 2 * at + 1 + (flat.take(row + column.take(at)) > cut.take(at))
            out[first:first + BLOCK] = value.take(at)
        return out


@dataclass
class Boosted:
    features: list[str]
    classes: list[str]
    cuts: list[np.ndarray]
    rate: float
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.searchsorted(cuts, x[:, j], "left")
        return out

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.leaves(bins)
        return out

    def importances(self) -> list[float]:
        """Share of each feature in the gain of all splits."""
        total = 0.0 if self.gains is None else float(self.gains.sum())
        return [float(g / total) if total else 0.0 for g in (self.gains if self.gains is not None else np.zeros(len(self.features)))]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted_attack`` and ``classifier_confidence`` (largest class probability)."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        at = {f: df.columns.index(f) for f in self.features if f in df.columns}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                x = np.zeros((batch.num_rows, len(model.features)))
                for j, f in enumerate(model.features):
                    if f in at:
                        x[:, j] = _numbers(batch.column(at[f]))
                if model.classes:
                    p = softmax(model.margins(model.binned(x)))
                    best = p.argmax(axis=1)
                    name, share = pa.array([model.classes[b] for b in best.tolist()]), pa.array(p[np.arange(len(p)), best])
                else:
                    name, share = pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, share, name], [*batch.schema.names, "classifier_confidence", "predicted_attack"])

        return df.mapInArrow(run, f"{kinds}, classifier_confidence double, predicted_attack string")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """Trees as a table: round, class, node, feature (null for leaves), threshold (values up to it go left), value (margin)."""
        rows = []
        for r, trees in enumerate(self.rounds):
            for k, t in enumerate(trees):
                for n in range(len(t.column)):
                    c = int(t.column[n])
                    if c >= 0:
                        rows.append((r, self.classes[k], n, self.features[c], float(self.cuts[c][t.bin[n]]), None))
                    elif n == 0 or t.column[(n - 1) // 2] >= 0:
                        rows.append((r, self.classes[k], n, None, None, float(self.rate * t.value[n])))
        return spark.createDataFrame(rows, "round int, class string, node int, feature string, threshold double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [[[t.column.tolist(), t.bin.tolist(), t.value.tolist()] for t in r] for r in self.rounds]
        text = json.dumps({"features": self.features, "classes": self.classes, "cuts": [c.tolist() for c in self.cuts], "rate": self.rate,
                           "depth": self.depth, "rounds": trees, "gains": None if self.gains is None else self.gains.tolist()})
        spark.createDataFrame([(text,)], "model string").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    m = json.loads(spark.read.parquet(path).first()["model"])
    rounds = [[Tree(np.array(c), np.array(b), np.array(v)) for c, b, v in r] for r in m["rounds"]]
    gains = None if m["gains"] is None else np.array(m["gains"])
    return Boosted(m["features"], m["classes"], [np.array(c) for c in m["cuts"]], m["rate"], m["depth"], rounds, gains)


def _numbers(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(np.asarray(column.cast(pa.float64()).fill_null(0.0)), nan=0.0)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Round:
    """One round as it grows: the trees so far, and for each class its columns and open nodes."""

    def __init__(self, number: int, model: Boosted, subsample: float, columns: float, seed: int):
        self.number, self.subsample, self.seed = number, subsample, seed
        self.classes, self.width = len(model.classes), len(model.features)
        size = 2 ** (model.depth + 1) - 1
        self.trees = [Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in model.classes]
        rng = np.random.default_rng([seed, number])
        some = max(1, round(columns * self.width))
        self.allowed = [np.sort(rng.permutation(self.width)[:some]) for _ in model.classes]
        self.open: list[list[int]] = [[0] for _ in model.classes]

    def drawn(self, key: np.ndarray) -> np.ndarray:
        """Rows of this round, by a hash of their keys."""
        x = key.astype(np.uint64) + np.uint64((self.seed * 1_000_003 + self.number) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < self.subsample

    def histograms(self, bins: np.ndarray, y: np.ndarray, key: np.ndarray, margins: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Class, node, sums (gradients and second derivatives by column and bin) of rows for all open nodes."""
        rows = np.nonzero(self.drawn(key))[0]
        bins, y = bins[rows], y[rows]
        p = softmax(margins[rows])
        for k in range(self.classes):
            if not self.open[k]:
                continue
            at = self.nodes_of(k, bins)
            there = np.bincount(at, minlength=len(self.trees[k].column))
            for node, both in zip(self.open[k], self.sums(k, bins, *gradients(p[:, k], y == k), at, self.open[k])):
                if there[node]:
                    yield k, node, both

    def sums(self, k: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        """Of some nodes, sums by column and bin of the rows that stand there; of columns that are not allowed, nothing."""
        slot = np.full(len(self.trees[k].column), -1)
        slot[nodes] = np.arange(len(nodes))
        out = np.zeros((len(nodes), 2, self.width, BINS), np.int64)
        for first in range(0, len(at), BLOCK):
            part = slice(first, first + BLOCK)
            mine = slot.take(at[part])
            rows = np.nonzero(mine >= 0)[0]
            some, base, gs, hs = bins[part], mine[rows] * BINS, g[part][rows], h[part][rows]
            for j in self.allowed[k]:
                where = base + some[:, j].take(rows)
                for i, x in enumerate((gs, hs)):
                    out[:, i, j] += np.bincount(where, x, len(nodes) * BINS).astype(np.int64).reshape(len(nodes), BINS)
        return out.reshape(len(nodes), 2, self.width * BINS)

    def nodes_of(self, k: int, bins: np.ndarray) -> np.ndarray:
        tree, at = self.trees[k], np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(tree.column) + 1))):
            column = tree.column[at]
            rows = np.nonzero(column >= 0)[0]
            at[rows] = 2 * at[rows] + 1 + (bins[rows, column[rows]] > tree.bin[at[rows]])
        return at

    def best(self, k: int, both: np.ndarray) -> tuple[float, float, int, int, float]:
        """Sums of a node, and column, bin and gain of its best split (-1: none)."""
        g, h = (x.reshape(self.width, BINS)[self.allowed[k]] for x in both)
        total_g, total_h = int(g[0].sum()) * UNIT, int(h[0].sum()) * UNIT
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1] * UNIT, np.cumsum(h, axis=1)[:, :-1] * UNIT
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g ** 2 / (left_h + PENALTY) + right_g ** 2 / (right_h + PENALTY) - total_g ** 2 / (total_h + PENALTY)
        gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -np.inf
        j, b = divmod(int(gain.argmax()), BINS - 1)
        if not gain[j, b] > 1e-6:
            return total_g, total_h, -1, 0, 0.0
        return total_g, total_h, int(self.allowed[k][j]), b, float(gain[j, b])

    def split(self, k: int, found: dict[int, tuple[float, float, int, int, float]], last: bool) -> list[tuple[int, float]]:
        """Apply the splits of a level of one class; their columns and gains."""
        tree, following, made = self.trees[k], [], []
        for node in self.open[k]:
            g, h, column, b, gain = found.get(node, (0.0, 0.0, -1, 0, 0.0))
            tree.value[node] = -g / (h + PENALTY)
            if column >= 0 and not last:
                tree.column[node], tree.bin[node] = column, b
                made.append((column, gain))
                following += [2 * node + 1, 2 * node + 2]
        self.open[k] = following
        return made

    def grow(self, found: dict[tuple[int, int], tuple[float, float, int, int, float]], last: bool, gains: np.ndarray) -> bool:
        """Apply the splits of a level; whether any node is open."""
        for k in range(self.classes):
            for column, gain in self.split(k, {node: v for (c, node), v in found.items() if c == k}, last):
                gains[column] += gain
        return any(self.open)

    def grow_class(self, k: int, depth: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[list[tuple[int, float]]]:
        """Grow the tree of one class from rows at hand (``bins`` by columns); columns and gains of the splits by level.

        Of two children the smaller one's sums are made, and taken from their parent's for the other.
        """
        tree, at, levels = self.trees[k], np.zeros(len(g), np.int64), []
        known = dict(zip([0], self.sums(k, bins, g, h, at, [0])))
        for level in range(depth + 1):
            there = np.bincount(at, minlength=len(tree.column))
            levels.append(self.split(k, {n: self.best(k, known[n]) for n in self.open[k] if there[n]}, level == depth))
            if not self.open[k]:
                break
            column = tree.column.take(at)
            for first in range(0, len(at), BLOCK):
                rows = first + np.nonzero(column[first:first + BLOCK] >= 0)[0]
                here = at[rows]
                # Only rows of this level's nodes stand in nodes with a column.
                at[rows] = 2 * here + 1 + (bins[rows, column[rows]] > tree.bin.take(here))
            there = np.bincount(at, minlength=len(tree.column))
            pairs = [(n, n + 1) if there[n] <= there[n + 1] else (n + 1, n) for n in self.open[k][::2]]
            made = self.sums(k, bins, g, h, at, [small for small, _ in pairs])
            known = {n: x for (small, large), x in zip(pairs, made) for n, x in ((small, x), (large, known[(small - 1) // 2] - x))}
        return levels


def gradients(p: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of one class in whole units."""
    return np.round((p - own) / UNIT), np.round(np.maximum(2 * p * (1 - p), 1e-16) / UNIT)


def _grow_here(model: Boosted, bins: np.ndarray, y: np.ndarray, key: np.ndarray, rounds: int, subsample: float, columns: float, seed: int,
               mine: Sequence[int], tell) -> None:
    """All rounds from rows at hand: the trees of the classes ``mine`` are grown here, ``tell`` gives those of all tasks for them."""
    margins, by_column = np.zeros((len(y), len(model.classes))), np.asfortranarray(bins)
    for number in range(rounds):
        now = Round(number, model, subsample, columns, seed)
        rows = np.nonzero(now.drawn(key))[0]
        p, own = softmax(margins[rows]), y[rows]
        some = np.empty((len(rows), bins.shape[1]), np.uint8, order="F")
        for j in range(bins.shape[1]):
            some[:, j] = by_column[:, j].take(rows)
        grown = {}
        for k in mine:
            levels = now.grow_class(k, model.depth, some, *gradients(p[:, k], own == k))
            grown[k] = (now.trees[k], levels)
        grown = tell(grown)
        for level in range(model.depth + 1):
            for k in range(len(model.classes)):
                for column, gain in (grown[k][1][level] if level < len(grown[k][1]) else ()):
                    model.gains[column] += gain
        trees = [grown[k][0] for k in range(len(model.classes))]
        for k, tree in enumerate(trees):
            margins[:, k] += model.rate * tree.leaves(bins)
        model.rounds.append(trees)


def _told(grown: dict) -> dict:
    """What all tasks of the barrier have grown in a round."""
    said = BarrierTaskContext.get().allGather(base64.b64encode(pickle.dumps(grown)).decode())
    return {k: v for text in said for k, v in pickle.loads(base64.b64decode(text)).items()}


def _rows(batches: Iterator[pa.RecordBatch], width: int, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        n = batch.num_rows
        if n:
            joined = lambda c, kind, w: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, w)
            yield joined("bins", np.uint8, width), np.asarray(batch.column("y")), np.asarray(batch.column("key")), joined("margins", "<f8", classes)


def fit(train: DataFrame, features: Sequence[str], target: str = "attack_type", key: str = "event_id", rounds: int = 150, depth: int = 6, rate: float = 0.1,
        subsample: float = 0.8, columns: float = 0.8, seed: int = 42, rows_per_task: int = ROWS_PER_TASK) -> Boosted:
    """Boosted trees for the classes of ``target``, in the order of their names."""
    features = list(features)
    classes = sorted(r[0] for r in train.where(F.col(target).isNotNull()).select(target).distinct().collect())
    x = {f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features}
    rows = train.where(F.col(target).isNotNull()).select(F.array_position(F.array(*map(F.lit, classes)), F.col(target)).alias("y") if classes else F.lit(0).alias("y"),
                                                         F.xxhash64(key).alias("key"), *(c.alias(f) for f, c in x.items()))
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f, shares, 20 * BINS).alias(f) for f in features)).first()
    model = Boosted(features, classes, [np.unique(np.array(cuts[f] or [], np.float64)) for f in features], rate, depth, gains=np.zeros(len(features)))
    if not classes:
        return model
    n, spark, width, k = cuts["n"], train.sparkSession, len(features), len(classes)
    tasks = -(-n // rows_per_task)
    bins_of = lambda batch: model.binned(np.stack([_numbers(batch.column(2 + j)) for j in range(width)], axis=1)) if width else np.zeros((batch.num_rows, 0), np.uint8)

    if tasks == 1:
        def packed(batch: pa.RecordBatch) -> list[np.ndarray]:
            return [np.asarray(batch.column(0)).astype(np.int64) - 1, np.asarray(batch.column(1)).astype(np.int64), bins_of(batch)]

        growers = max(1, min(k, slots(spark))) if n > BARRIER_ROWS else 1
        table = written(packed_rows(rows, packed), "binned")

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y, keys, bins = unpacked(batches, [(np.int64, 1), (np.int64, 1), (np.uint8, width)])
            me = BarrierTaskContext.get().partitionId() if growers > 1 else 0
            grown = Boosted(features, classes, model.cuts, rate, depth, gains=np.zeros(width))
            _grow_here(grown, bins, y[:, 0], keys[:, 0], rounds, subsample, columns, seed, range(me, k, growers), _told if growers > 1 else dict)
            for r, trees in enumerate(grown.rounds if me == 0 else ()):
                for c, t in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([c]), pa.array([t.column.tolist()]), pa.array([t.bin.tolist()]), pa.array([t.value.tolist()]),
                                                      pa.array([grown.gains.tolist() if r + c == 0 else None], pa.list_(pa.float64()))], ["r", "c", "column", "bin", "value", "gains"])

        made = to_each_task(table, growers).mapInArrow(
            whole, "r bigint, c bigint, column array<bigint>, bin array<bigint>, value array<double>, gains array<double>", barrier=growers > 1).collect()
        made.sort(key=lambda r: (r["r"], r["c"]))
        for r in made:
            if r["c"] == 0:
                model.rounds.append([])
            model.rounds[-1].append(Tree(np.array(r["column"]), np.array(r["bin"]), np.array(r["value"])))
            model.gains = np.array(r["gains"]) if r["gains"] is not None else model.gains
        return model

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(batch.column(0)).astype(np.int64) - 1), batch.column(1), pa.array([b.tobytes() for b in bins_of(batch)], pa.binary()),
                 pa.array([bytes(8 * k)] * batch.num_rows, pa.binary())], ["y", "key", "bins", "margins"])

    table = written(rows.mapInArrow(binned, "y bigint, key bigint, bins binary, margins binary").repartition(tasks), "binned")
    renewed = 0
    for number in range(rounds):
        if number - renewed == RENEW:
            table, renewed = written(_with_margins(table, model, renewed), "binned"), number
        now = Round(number, model, subsample, columns, seed)
        for level in range(depth + 1):
            found = _level(spark, table, model, renewed, now)
            if not now.grow(found, level == depth, model.gains):
                break
        model.rounds.append(now.trees)
    return model


def _with_margins(table: DataFrame, model: Boosted, first: int) -> DataFrame:
    shared, width, k = table.sparkSession.sparkContext.broadcast(model), len(model.features), len(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, _, _, margins in _rows(iter([batch]), width, k):
                new = margins + shared.value.margins(bins, first)
                yield batch.set_column(3, "margins", pa.array([m.tobytes() for m in new.astype("<f8")], pa.binary()))

    return table.mapInArrow(run, table.schema)


def _level(spark: SparkSession, table: DataFrame, model: Boosted, first: int, now: Round) -> dict:
    """Sums and best split of each open node of a round, over all rows."""
    shared, width, k = spark.sparkContext.broadcast((model, now)), len(model.features), len(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for bins, y, key, margins in _rows(batches, width, k):
            for c, node, both in now.histograms(bins, y, key, margins + model.margins(bins, first)):
                if (c, node) in sums:
                    sums[c, node] += both
                else:
                    sums[c, node] = both
        for (c, node), both in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([node]), pa.array([both.tobytes()], pa.binary())], ["c", "node", "sums"])

    def chosen(group: pa.Table) -> pa.Table:
        c, node = group.column("c")[0].as_py(), group.column("node")[0].as_py()
        both = sum(np.frombuffer(s, np.int64) for s in group.column("sums").to_pylist()).reshape(2, -1)
        g, h, column, b, gain = shared.value[1].best(c, both)
        return pa.table({"c": [c], "node": [node], "g": [g], "h": [h], "column": [column], "bin": [b], "gain": [gain]})

    made = table.mapInArrow(run, "c bigint, node bigint, sums binary").groupBy("c", "node").applyInArrow(
        chosen, "c bigint, node bigint, g double, h double, column bigint, bin bigint, gain double")
    return {(r["c"], r["node"]): (r["g"], r["h"], r["column"], r["bin"], r["gain"]) for r in made.collect()}
