"""Exact search for the largest inner products, by buckets of vectors of like length.

Vectors become whole numbers, are sorted by length over all tasks, and packed into buckets. Queries are packed into blocks.
Each block first meets the bucket of the longest vectors, which bounds its queries' k-th scores from below; buckets too
short to reach any query's bound are never sent to the block. A block then meets the others in spans of buckets, longest first.
The k-th score that a query has so far, over the lengths of query and bucket, is the least cosine that could still count
there (the local threshold):
- over one, the bucket holds nothing for the query;
- where it leaves few values of one of the query's largest coordinates possible, by sorted lists of the bucket's coordinates,
  only vectors within the ranges of several such coordinates are verified;
- else all vectors of the bucket that are long enough are.
Verifying computes products exactly. Bounds are floating-point and are widened by SLACK, so ties are never pruned.

Scale: a (block, span) pair is one unit of work of bounded size; how many there are follows from the question, all queries
against all rows. A span gives a query at most k rows, those over its bound.

Defined cases: vectors that are null, or hold null or non-finite components, take no part (nor do those whose squared length
is no finite double); a query meets vectors of as many
components; its own row is no candidate, but other rows of the same id are; repeated queries are queries of their own (their
column `query_row` tells them apart); ties go to the smaller id, nulls last, then to the smaller row; scores beyond a long are
given as the nearest long, but compared exactly; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written
from .common import column
from .ordered import map_rows

#: Bytes of the numbers of a bucket or a block of queries, and the most rows of either; buckets of a span.
PACK_BYTES, MOST_ROWS, SPAN = 2 << 20, 4096, 16
SLACK = 1e-9
#: Coordinates whose ranges are looked at, and the share of a bucket up to which these choose the candidates.
FOCUS, FEW = 4, 0.1
#: The longest buckets are broadcast if there are no more of them, one for each number of components.
BROADCAST_DIMS = 16
#: Products below are exact as doubles.
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_PACKED = "part int, seq int, dim int, n int, longest double, most double, ids binary, marks binary, places binary, numbers binary"


def whole_numbers(rows: DataFrame, factor: float, id_col: str, vector_col: str, query: Column) -> DataFrame:
    """The vectors that take part, times a factor and rounded down: id, is_query, dim, length, most (largest absolute number),
    numbers (16-bit integers if they fit, else doubles)."""
    rows = rows.filter(column(vector_col).isNotNull()).select(
        column(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("is_query"), column(vector_col).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            flat = lists.values
            null = np.asarray(flat.is_null())
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(factor * np.asarray(flat.fill_null(np.nan)))
                bad = null | ~np.isfinite(x * x)
                for i, q, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    v = x[a:b]
                    square = float(v @ v)
                    if not bad[a:b].any() and square < np.inf:
                        most = float(np.abs(v).max(initial=0.0))
                        yield i, q, b - a, square ** 0.5, most, v.astype("<i2" if most < 32768 else "<f8").tobytes()

    return map_rows(rows, run, "id bigint, is_query boolean, dim int, length double, most double, numbers binary", rows=4096)


def packed(held: list[tuple], part: int, seq: int) -> tuple:
    """A row of _PACKED from vectors (id, mark, dim, length, most, numbers, place)."""
    dim, most = held[0][2], max(h[4] for h in held)
    numbers = b"".join(h[5] if most < 32768 or len(h[5]) == 8 * dim else np.frombuffer(h[5], "<i2").astype("<f8").tobytes() for h in held)
    return (part, seq, dim, len(held), max(h[3] for h in held), most, np.array([h[0] for h in held], "<i8").tobytes(),
            bytes(h[1] for h in held), np.array([h[6] for h in held], "<i8").tobytes(), numbers)


def room(dim: int) -> int:
    return min(MOST_ROWS, max(1, PACK_BYTES // (8 * max(dim, 1))))


def buckets_of(vectors: DataFrame) -> DataFrame:
    """Vectors sorted by dim and length, the longest first, in buckets; marks are 1 for queries and 2 more for null ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for i, q, dim, length, most, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (dim != held[0][2] or len(held) == room(dim)):
                    yield packed(held, part, seq)
                    held, seq = [], seq + 1
                held.append((i or 0, q + 2 * (i is None), dim, length, most, numbers, (part << 40) + (seq << 20) + len(held)))
        if held:
            yield packed(held, part, seq)

    by = [F.col("dim"), F.col("length").desc(), F.col("id"), F.col("is_query")]
    return map_rows(vectors.repartitionByRange(*by).sortWithinPartitions(*by), run, _PACKED, rows=1)


def blocks_of(buckets: DataFrame) -> DataFrame:
    """The queries of buckets, put together in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, held = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = Vectors(row)
                for i in np.nonzero(vectors.queries)[0].tolist():
                    mine = held.setdefault(vectors.dim, [])
                    most = float(np.abs(vectors.x[i]).max(initial=0.0))
                    mine.append((int(vectors.ids[i]), int(2 * vectors.null[i]), vectors.dim, float(vectors.length[i]), most,
                                 vectors.x[i].astype("<i2" if most < 32768 else "<f8").tobytes(), int(vectors.places[i])))
                    if len(mine) == room(vectors.dim):
                        yield packed(held.pop(vectors.dim), part, seq)
                        seq += 1
        for mine in held.values():
            yield packed(mine, part, seq)
            seq += 1

    return map_rows(buckets, run, _PACKED, rows=1)


class Vectors:
    """A bucket or a block as arrays. A vector's place tells it from all others."""

    def __init__(self, row: tuple):
        _, _, self.dim, n, self.longest, self.most, ids, marks, places, numbers = row
        kind = "<i2" if self.most < 32768 else "<f8"
        self.ids, self.places = np.frombuffer(ids, "<i8"), np.frombuffer(places, "<i8")
        marks = np.frombuffer(marks, np.uint8)
        self.queries, self.null = marks & 1 > 0, marks >= 2
        self.x = np.frombuffer(numbers, kind).reshape(n, self.dim).astype(np.float64)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))

    def unit(self) -> np.ndarray:
        return self.x / np.where(self.length > 0, self.length, 1)[:, None]


class Search:
    """The k best of each query of a block so far."""

    def __init__(self, block: Vectors, k: int, floor: np.ndarray | None = None):
        self.block, self.k = block, k
        self.found: list[list[tuple]] = [[] for _ in block.ids]
        #: Scores below cannot be among the k best: the k-th so far, or a bound known beforehand.
        self.least = np.full(len(block.ids), -np.inf) if floor is None else floor.copy()

    def needed(self) -> np.ndarray:
        """The least length that can still count for each query; nothing can be left out for a bound that is not positive."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.least > 0, self.least / self.block.length * (1 - SLACK), 0.0)

    def meet(self, bucket: Vectors) -> None:
        """Bring the queries together with a bucket."""
        exact = self.block.most * bucket.most * max(bucket.dim, 1) < EXACT
        local = self.needed() / bucket.longest if bucket.longest > 0 else np.where(self.least > 0, np.inf, 0.0)
        live = np.nonzero(local <= 1)[0]
        chosen = self.near_coordinates(bucket, local, live) if exact else {}
        for q, at in chosen.items():
            self.verify(q, bucket.x[at] @ self.block.x[q], at, bucket)
        rest = live[~np.isin(live, list(chosen))] if chosen else live
        step = max(1, (1 << 21) // max(len(bucket.ids), 1))
        for first in range(0, len(rest), step):
            part = rest[first:first + step]
            # Buckets are sorted by length: those that are long enough stand in front.
            n = int(np.searchsorted(-bucket.length, -self.needed()[part].min(), "right"))
            a, b = self.block.x[part], bucket.x[:n]
            products = a @ b.T if exact else _integers(a) @ _integers(b).T
            for q, row in zip(part.tolist(), products):
                self.verify(q, row, np.arange(n), bucket)

    def near_coordinates(self, bucket: Vectors, local: np.ndarray, live: np.ndarray) -> dict[int, np.ndarray]:
        """Candidates of the queries for which the ranges of their largest coordinates leave few."""
        able = live[(local[live] > 0.5) & (self.block.length[live] > 0)]
        if not len(able) or not bucket.dim:
            return {}
        # At a cosine of at least t to a query whose coordinate is c, a vector's own is within c t +- sqrt((1 - c^2) (1 - t^2));
        # the range ends at 1 or -1 if that is nearer to the query than the cosine.
        query, t = self.block.x[able] / self.block.length[able][:, None], local[able][:, None]
        focus = np.argsort(-np.abs(query), axis=1, kind="stable")[:, :FOCUS]
        c = np.take_along_axis(query, focus, axis=1)
        wide = np.sqrt(np.maximum((1 - c * c) * (1 - t * t), 0)) + 1e-7
        low, high = np.where(c <= -t, -1.0 - SLACK, c * t - wide), np.where(c >= t, 1.0 + SLACK, c * t + wide)
        unit = bucket.unit()
        orders, first, last = {}, np.zeros(focus.shape, np.int64), np.full(focus.shape, len(unit))
        for f in np.unique(focus[high - low < 1]).tolist():
            orders[f] = np.argsort(unit[:, f], kind="stable")
            values, here = unit[orders[f], f], focus == f
            first[here], last[here] = np.searchsorted(values, low[here], "left"), np.searchsorted(values, high[here], "right")
        size = last - first
        best = size.argmin(axis=1)
        out = {}
        for j in np.nonzero(size.min(axis=1) <= FEW * len(unit))[0].tolist():
            f = int(focus[j, best[j]])
            at = orders[f][first[j, best[j]]:last[j, best[j]]]
            for g, a, b in zip(focus[j].tolist(), low[j].tolist(), high[j].tolist()):
                at = at[(unit[at, g] >= a) & (unit[at, g] <= b)]
            out[int(able[j])] = at
        return out

    def verify(self, q: int, scores: np.ndarray, at: np.ndarray, bucket: Vectors) -> None:
        """Add what is among the query's k best by its exact score."""
        least = self.least[q]
        keep = bucket.places[at] != self.block.places[q]
        if scores.dtype == object:
            keep &= np.array([float(s) >= least - abs(least) * SLACK for s in scores], bool)
            scores, at = scores[keep], at[keep]
        else:
            keep &= scores >= least
            scores, at = scores[keep], at[keep]
            if len(at) > self.k:  # of equal scores the least ids stay
                kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                near = np.nonzero(scores >= kth)[0]
                near = near[np.lexsort((bucket.places[at[near]], bucket.ids[at[near]], bucket.null[at[near]], -scores[near]))[:self.k]]
                scores, at = scores[near], at[near]
        if not len(at):
            return
        mine = self.found[q]
        mine += [(-int(s), bool(bucket.null[i]), int(bucket.ids[i]), int(bucket.places[i])) for s, i in zip(scores.tolist(), at.tolist())]
        mine.sort()
        del mine[self.k:]
        if len(mine) == self.k:
            self.least[q] = max(least, float(-mine[-1][0]))

    def rows(self) -> Iterator[tuple]:
        for q, mine in enumerate(self.found):
            query = None if self.block.null[q] else int(self.block.ids[q])
            for negated, null, i, place in mine:
                score = max(-_LONG - 1, min(_LONG, -negated))
                # Scores beyond a long are compared by all their digits.
                digits = None if abs(score) < _LONG else (-negated + (1 << 2047)).to_bytes(256, "big")
                yield query, int(self.block.places[q]), None if null else i, place, score, digits


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out[...] = [[int(v) for v in row] for row in x.tolist()]
    return out


def bounded(blocks: DataFrame, longest: DataFrame, k: int) -> DataFrame:
    """Blocks with a lower bound of each query's k-th score, and `reach`: the least length that can count for any query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                mine, bucket = row[:10], row[10:]
                search = Search(Vectors(mine), k)
                search.meet(Vectors(bucket))
                yield (*mine, search.least.astype("<f8").tobytes(), float(search.needed().min()))

    other = longest.select(*(F.col(c).alias(f"_{c}") for c in longest.columns))
    return map_rows(blocks.join(other, F.col("dim") == F.col("_dim")), run, _PACKED + ", least binary, reach double", rows=1)


def search(rows: DataFrame, query: Column, k: int, factor: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
           span: int = SPAN) -> DataFrame:
    """The k largest inner products of each query with other rows: query_id, query_row, rank (from 1), vec_id, score."""
    buckets = written(buckets_of(whole_numbers(rows, factor, id_col, vector_col, query)), "buckets")
    names = buckets.columns
    tops = buckets.groupBy("dim").agg(F.max_by(F.struct("part", "seq"), F.struct("longest", -F.col("part"), -F.col("seq"))).alias("top"))
    tops = written(tops.select("dim", "top.part", "top.seq").join(buckets, ["dim", "part", "seq"]).select(*names), "longest-buckets")
    few = tops.limit(BROADCAST_DIMS + 1).count() <= BROADCAST_DIMS
    blocks = written(bounded(blocks_of(buckets), F.broadcast(tops) if few else tops, k), "blocks")
    # Pairs of a block and a span of buckets that can hold something for it; rows are not paired here.
    buckets = buckets.withColumn("span", F.floor(F.col("seq") / span).cast("int"))
    spans = buckets.groupBy("dim", F.col("part").alias("s_part"), "span").agg(F.max("longest").alias("s_longest"))
    cells = blocks.select("dim", F.col("part").alias("b_part"), F.col("seq").alias("b_seq"), "reach").join(spans, "dim").filter("s_longest >= reach")
    cells = written(cells.select("dim", "b_part", "b_seq", "s_part", "span"), "cells")
    key = ["b_part", "b_seq", "s_part", "span"]
    left = cells.join(blocks.withColumnsRenamed({"part": "b_part", "seq": "b_seq"}), ["dim", "b_part", "b_seq"]).select(
        *key, F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("seq"), *names[2:], "least")
    right = cells.join(buckets.withColumnRenamed("part", "s_part"), ["dim", "s_part", "span"]).select(
        *key, F.lit(1).alias("kind"), F.col("s_part").alias("part"), "seq", *names[2:], F.lit(None).cast("binary").alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = Vectors(row[5:15])
                if row[4] == 0:
                    if now is not None:
                        yield from now.rows()
                    now = Search(vectors, k, np.frombuffer(row[15], "<f8"))
                else:
                    now.meet(vectors)
        if now is not None:
            yield from now.rows()

    met = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind", F.col("longest").desc(), "seq")
    found = map_rows(met, run, "query_id bigint, query_row bigint, vec_id bigint, vec_row bigint, score bigint, digits binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("digits"), F.col("vec_id").asc_nulls_last(), "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")
