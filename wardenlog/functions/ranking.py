"""Exact order statistics without ordering the data.

A value at a given rank is found by counting: histogram the range, keep the bin that holds the rank, repeat in
that bin. Each round is one partially aggregated scan that returns a few hundred counts, so no task ever holds
more than a histogram or the few rows of the last bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written

BINS = 512
LAST_BIN_ROWS = 10_000
RANGE_ROWS = 200_000


class AtRank(NamedTuple):
    """A value, the number of smaller values, and the number of values equal to it."""

    value: float | int
    below: int
    equal: int


def _values(df: DataFrame, value: Column) -> DataFrame:
    """The values that have a rank: neither null nor NaN."""
    vals = df.select(value.alias("_x")).where(F.col("_x").isNotNull())
    return vals.where(~F.isnan("_x")) if dict(vals.dtypes)["_x"] in ("double", "float") else vals


def value_at_rank(df: DataFrame, value: Column, ranks: Sequence[int], lo=None, hi=None) -> dict[int, AtRank]:
    """The values at 0-based ``ranks`` of ``value`` in ascending order; nulls and NaN have no rank."""
    vals = _values(df, value)
    if lo is None or hi is None:
        lo, hi = vals.agg(F.min("_x"), F.max("_x")).first()
    if lo is None:
        return {}
    return _refine(vals, lo, hi, sorted(set(ranks)), 0)


def _refine(vals: DataFrame, lo, hi, ranks: list[int], below: int) -> dict[int, AtRank]:
    """``below``: number of values smaller than ``lo``; all ranks fall into [lo, hi]."""
    # One bin if all values are equal.
    width = (hi - lo) / BINS or 1.0
    inside = vals.where(F.col("_x").between(lo, hi))
    bin_of = F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = (
        inside.groupBy(bin_of.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        .collect()
    )
    found, start = {}, below
    for b in sorted(counts, key=lambda c: c["_bin"]):
        here = [r for r in ranks if start <= r < start + b["n"]]
        if here and b["lo"] == b["hi"]:
            found.update({r: AtRank(b["lo"], start, b["n"]) for r in here})
        elif here:
            part = inside.where(F.col("_x").between(b["lo"], b["hi"]))
            if b["n"] <= LAST_BIN_ROWS:
                ordered = sorted(row["_x"] for row in part.collect())
                for r in here:
                    v = ordered[r - start]
                    first = bisect_left(ordered, v)
                    found[r] = AtRank(v, start + first, bisect_right(ordered, v) - first)
            else:
                found.update(_refine(part, b["lo"], b["hi"], here, start))
        start += b["n"]
    return found


def percentiles(df: DataFrame, value: Column, fractions: Sequence[float]) -> list[float]:
    """Exact percentiles with linear interpolation between neighbouring ranks."""
    vals = _values(df, value)
    n, lo, hi = vals.agg(F.count("_x"), F.min("_x"), F.max("_x")).first()
    if n == 0:
        return [math.nan for _ in fractions]
    at = [(n - 1) * f for f in fractions]
    wanted = {math.floor(a) for a in at} | {math.ceil(a) for a in at}
    found = value_at_rank(vals, F.col("_x"), sorted(wanted), lo, hi)
    v = {r: at_rank.value for r, at_rank in found.items()}
    return [float(v[math.floor(a)] + (v[math.ceil(a)] - v[math.floor(a)]) * (a - math.floor(a))) for a in at]


def string_at_rank(df: DataFrame, column: str, rank: int, n: int) -> str | None:
    """The string at 0-based ``rank`` of ``n`` rows: ranges of strings are written and counted, then the one that holds
    the rank is ordered."""
    if rank >= n:
        return None
    ranges = written(df.select(column).repartitionByRange(column).withColumn("_range", F.spark_partition_id()), "string-ranges")
    for r in sorted(ranges.groupBy("_range").count().collect()):
        if rank < r["count"]:
            return ranges.where(F.col("_range") == r["_range"]).orderBy(column).offset(rank).first()[0]
        rank -= r["count"]
    return None


def cumulative_by_value(df: DataFrame, value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Running totals over distinct values of ``value``: ``sums`` maps a counted column to the total's name.

    ``df`` holds one row per distinct value. The order is cut into ranges of about ``RANGE_ROWS`` values, each a
    partition of a range-partitioned table; totals of the ranges before are carried in, so the running sum is not one
    task over all values.
    """
    df = written(df, "distinct-values")
    n = max(1, -(-df.count() // RANGE_ROWS))
    ranges = written(df.repartitionByRange(n, value).withColumn("_range", F.spark_partition_id()), "value-ranges")
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # A row for each RANGE_ROWS values.
    range_order = F.col("_range").desc() if descending else F.col("_range").asc()
    earlier = W.partitionBy(F.lit(0)).orderBy(range_order).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("_range", *[F.sum(f"_t_{c}").over(earlier).alias(f"_c_{c}") for c in sums])
    return (
        ranges.withColumns({new: F.sum(c).over(inside) for c, new in sums.items()})
        .join(carry, "_range", "left")
        .withColumns({new: F.col(new) + F.coalesce(f"_c_{c}", F.lit(0)) for c, new in sums.items()})
        .drop("_range", *[f"_c_{c}" for c in sums])
    )
