"""Ordered computations per key that survive hot keys.

A plain window puts all rows of a key into one task, and a sliding frame is re-evaluated for every row. Here

* a key that holds more than ``max_rows`` rows is split into consecutive slices of about equal numbers of rows,
  at quantiles of its times, and what crosses a slice border (last row, counts, sums) is carried over through a
  small per-slice summary;
* trailing time frames are running sums over enter and leave points, so a row costs the same whatever the
  length of the frame;
* trailing distinct counts first shrink the occurrences of a value to one interval per short time slice, with
  map-side aggregation, before anything is ordered.

Hot keys are found by one counting pass; the quantiles take another one over their rows alone. Their table is
written, and adaptive execution decides how it is joined. If there is none, no summary is computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import written
from .columns import micros

MAX_ROWS_PER_TASK = 1_000_000
#: Quantiles taken of a hot key's times; a key is cut into so many slices at most.
QUANTILES = 2_000


@dataclass(frozen=True)
class HotKeys:
    """Keys too large for one task, with the times at which their slices begin but for the first."""

    keys: tuple[str, ...]
    table: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.table is not None


def find_hot_keys(
    df: DataFrame, keys: str | Sequence[str], time: str = "timestamp", max_rows: int = MAX_ROWS_PER_TASK
) -> HotKeys:
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    times = df.select(*keys, micros(time).alias("_us"))
    large = written(times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows), "large-keys")
    if large.isEmpty():
        return HotKeys(keys)
    fractions = [i / QUANTILES for i in range(1, QUANTILES)]
    cut = times.join(large, list(keys)).groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.percentile_approx("_us", fractions, 20 * QUANTILES).alias("_q"))
    # Every so many quantiles make a slice of at most max_rows rows, as far as quantiles go.
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES * int(max_rows)) / F.col("_n")).cast("int"))
    cut = cut.withColumn("_step", step)
    edges = F.expr(f"array_distinct(transform(sequence(_step, greatest(_step, {QUANTILES - 1}), _step), i -> _q[least(i, {QUANTILES - 1}) - 1]))")
    return HotKeys(keys, written(cut.select(*keys, edges.alias("_edges")), "hot-keys"))


def _slice(df: DataFrame, at: str, hot: HotKeys | None) -> tuple[DataFrame, list[str]]:
    """Add the slice number of the point ``at`` for hot keys; returns the extra partition columns."""
    if not hot:
        return df, []
    sliced = (
        df.join(hot.table, list(hot.keys), "left")
        .withColumn("_slice", F.when(F.col("_edges").isNotNull(), F.size(F.filter("_edges", lambda e: e <= F.col(at)))))
        .drop("_edges")
    )
    return sliced, ["_slice"]


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, "_slice"], "left")


def with_previous(
    df: DataFrame,
    keys: str | Sequence[str],
    columns: dict[str, str],
    time: str = "timestamp",
    tie: str = "event_id",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Values of the key's previous row in (time, tie) order: ``columns`` maps source to new name."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    work, extra = _slice(df.withColumn("_us", micros(time)), "_us", hot)
    w = W.partitionBy(*keys, *extra).orderBy("_us", tie)
    if not hot:
        return work.withColumns({new: F.lag(c).over(w) for c, new in columns.items()}).drop("_us")

    packed = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    tails = (
        work.where(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max_by(packed, F.struct("_us", tie)).alias("_tail"))
    )
    before = W.partitionBy(*keys).orderBy("_slice")
    carry = tails.withColumn("_carry", F.lag("_tail").over(before)).drop("_tail")
    out = _join_carry(work.withColumn("_prev", F.lag(packed).over(w)), carry, keys)
    prev = F.coalesce("_prev", "_carry")
    return out.withColumns({new: prev[new] for new in columns.values()}).drop(
        "_us", "_slice", "_prev", "_carry"
    )


def with_position(
    df: DataFrame,
    keys: str | Sequence[str],
    name: str,
    time: str = "timestamp",
    tie: str = "event_id",
    hot: HotKeys | None = None,
) -> DataFrame:
    """1-based position of the row among its key's rows in (time, tie) order."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    work, extra = _slice(df.withColumn("_us", micros(time)), "_us", hot)
    w = W.partitionBy(*keys, *extra).orderBy("_us", tie)
    numbered = work.withColumn(name, F.row_number().over(w).cast("bigint"))
    if not hot:
        return numbered.drop("_us")
    counts = work.where(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = counts.withColumn("_before", F.sum("_n").over(before)).drop("_n")
    return (
        _join_carry(numbered, carry, keys)
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_us", "_slice", "_before")
    )


@dataclass(frozen=True)
class Trailing:
    """Sum of a bigint expression over the key's rows in ``[t - length, t)``, or ``[t - length, t]``."""

    name: str
    value: Column
    length: int
    inclusive: bool = False


@dataclass(frozen=True)
class TrailingDistinct:
    """Number of distinct values of a column over the key's rows in ``[t - length, t]``."""

    name: str
    column: str
    length: int


def _distinct_points(
    df: DataFrame, keys: list[str], column: str, measures: list[TrailingDistinct]
) -> DataFrame:
    """Points at which the number of live values of ``column`` changes.

    Occurrences of a value inside one slice of the shortest frame follow each other within every frame, so the
    slice's first and last occurrence say all. Partial aggregation does this before the shuffle, and leaves at
    most (time span / frame) rows per value.
    """
    step = min(m.length for m in measures)
    spans = (
        df.select(*keys, column, micros("timestamp").alias("_us"))
        .groupBy(*keys, column, F.expr(f"_us div {step}").alias("_step"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    )
    w = W.partitionBy(*keys, column).orderBy("_step")
    spans = spans.withColumns({
        "_gap_before": F.col("_first") - F.lag("_last").over(w),
        "_gap_after": F.lead("_first").over(w) - F.col("_last"),
    })
    # A point counts for rows after it: entering "at t" is a point one microsecond earlier.
    points = []
    for m in measures:
        starts = F.col("_gap_before").isNull() | (F.col("_gap_before") > m.length)
        ends = F.col("_gap_after").isNull() | (F.col("_gap_after") > m.length)
        points += [
            F.when(starts, _point(F.col("_first") - 1, {m.name: F.lit(1)}, measures)),
            F.when(ends, _point(F.col("_last") + m.length, {m.name: F.lit(-1)}, measures)),
        ]
    exploded = spans.select(*keys, F.explode(F.array_compact(F.array(*points))).alias("_pt"))
    return exploded.select(*keys, "_pt.*")


def _point(at: Column, deltas: dict[str, Column], measures) -> Column:
    return F.struct(
        at.alias("_at"),
        *[deltas.get(m.name, F.lit(0)).cast("bigint").alias(f"_d_{m.name}") for m in measures],
    )


def with_trailing(
    df: DataFrame,
    keys: str | Sequence[str],
    measures: Sequence[Trailing | TrailingDistinct],
    hot: HotKeys | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add trailing time-frame measures per key, exact to the microsecond, as bigint columns.

    ``source``: a cheaper frame with the same rows to count distinct values from (default: ``df``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sums = [m for m in measures if isinstance(m, Trailing)]
    distincts = [m for m in measures if isinstance(m, TrailingDistinct)]
    payload = df.columns

    # Row points carry the row itself; leave points carry only key, time and deltas.
    work = df.withColumn("_us", micros("timestamp")).withColumns(
        {f"_v_{m.name}": F.coalesce(m.value.cast("bigint"), F.lit(0)) for m in sums}
    )
    value = {m.name: F.col(f"_v_{m.name}") for m in sums}
    row = F.struct(*[c for c in payload if c not in keys])

    def pt(is_row: bool, at: Column, deltas: dict[str, Column]) -> Column:
        return F.struct(_point(at, deltas, sums).alias("_pt"), (row if is_row else F.lit(None)).alias("_row"))

    points = [pt(True, F.col("_us"), {m.name: value[m.name] for m in sums if not m.inclusive})]
    entering = {m.name: value[m.name] for m in sums if m.inclusive}
    if entering:
        nonzero = _any_nonzero(entering.values())
        points.append(F.when(nonzero, pt(False, F.col("_us") - 1, entering)))
    for length in sorted({m.length for m in sums}):
        leaving = {m.name: value[m.name] for m in sums if m.length == length}
        minus = {n: -v for n, v in leaving.items()}
        points.append(F.when(_any_nonzero(leaving.values()), pt(False, F.col("_us") + length, minus)))

    deltas = [f"_d_{m.name}" for m in measures]
    swept = work.select(*keys, F.explode(F.array_compact(F.array(*points))).alias("_e"))
    swept = swept.select(*keys, "_e._row", "_e._pt.*")
    for column in dict.fromkeys(m.column for m in distincts):
        group = [m for m in distincts if m.column == column]
        changes = _distinct_points(source if source is not None else df, keys, column, group)
        swept = swept.unionByName(changes, allowMissingColumns=True)

    swept, extra = _slice(swept, "_at", hot)
    strictly_before = W.partitionBy(*keys, *extra).orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    out = swept.withColumns({m.name: F.sum(f"_d_{m.name}").over(strictly_before) for m in measures}).where(
        F.col("_row").isNotNull()
    )
    restored = [c if c in keys else F.col(f"_row.{c}").alias(c) for c in payload]
    if hot:
        totals = (
            swept.where(F.col("_slice").isNotNull())
            .groupBy(*keys, "_slice")
            .agg(*[F.sum(d).alias(d) for d in deltas])
        )
        earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carry = totals.select(*keys, "_slice", *[F.sum(d).over(earlier).alias(f"{d}_c") for d in deltas])
        out = _join_carry(out.drop(*deltas), carry, keys)
        return out.select(*restored, *[
            (F.coalesce(m.name, F.lit(0)) + F.coalesce(f"_d_{m.name}_c", F.lit(0))).cast("bigint").alias(m.name)
            for m in measures
        ])
    return out.select(*restored, *[F.coalesce(m.name, F.lit(0)).cast("bigint").alias(m.name) for m in measures])


def _any_nonzero(values) -> Column:
    condition = F.lit(False)
    for v in values:
        condition = condition | (v != 0)
    return condition
