"""Running sums along each key's order, for keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..scratch import written

_WHOLE, _HALF = 1 << 64, 1 << 63


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """`df`, written to the shared folder, with columns of running sums (modulo 2^64): names of results to columns of longs.

    Rows are sorted by key and order over all tasks, so a key of any size is dealt to many of them. Each task sums within
    its own range; only the totals of the last key of each task, one row a task, are carried on to the next.
    `key` is a column of longs; its nulls are a key of their own.
    """
    columns, at = df.columns, df.columns.index(key)
    out = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in sums), StructField("_part", IntegerType()),
                      StructField("_goes_on", BooleanType()), StructField("_first_key", LongType()), StructField("_ends", BooleanType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, first, group, held = None, None, -1, None
        total = np.zeros(len(sums), np.int64)
        for batch in batches:
            n, ids = batch.num_rows, batch.column(at)
            if not n:
                continue
            null = np.asarray(ids.is_null())
            values = np.asarray(ids.fill_null(0))
            new = np.ones(n, bool)
            new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
            new[0] = last is None or last != (values[0], null[0])
            if last is None:
                first = ids[0].as_py()
            starts = np.nonzero(new)[0]
            within = np.cumsum(new)
            made = []
            for j, c in enumerate(sums.values()):
                x = np.cumsum(np.asarray(batch.column(columns.index(c))))
                # What is to be taken off: the sum before the key's first row. The key of the batch before may go on.
                before = np.concatenate([[-total[j]], np.where(starts > 0, x[starts - 1], 0)])
                made.append(x - before[within])
            last, total = (values[-1], null[-1]), np.array([x[-1] for x in made], np.int64)
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in made), pa.array(np.full(n, part, np.int32)), pa.array(group + within == 0),
                 pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], schema=arrow)
            group += int(within[-1])
        if held is not None:  # the task's last row tells the driver where its keys begin and end
            n = held.num_rows
            held = held.set_column(held.num_columns - 2, arrow.field("_first_key"), pa.array([None] * (n - 1) + [first], pa.int64()))
            yield held.set_column(held.num_columns - 1, arrow.field("_ends"), pa.array([False] * (n - 1) + [True]))

    by = [F.col(key).asc_nulls_first(), *order]
    found = written(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, out), name)
    carry, so_far, last = [], [0] * len(sums), ()
    for r in found.filter("_ends").select("_part", "_goes_on", "_first_key", F.col(key).alias("_key"), *sums).orderBy("_part").collect():
        same = last == (r["_first_key"],)
        if same:
            carry.append((r["_part"], *so_far))
        own = [r[c] for c in sums]
        # A task with one key only passes on what it got as well.
        so_far = [wrapped(a + b) for a, b in zip(so_far, own)] if same and r["_goes_on"] else own
        last = (r["_key"],)
    schema = ", ".join(["_to int", *(f"_{c} bigint" for c in sums)])
    carried = df.sparkSession.createDataFrame(carry, schema)
    parts = found.join(F.broadcast(carried), (F.col("_part") == F.col("_to")) & F.col("_goes_on"), "left")
    return parts.select(*columns, *(_added(F.col(c), F.col(f"_{c}")).alias(c) for c in sums))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str, rows: int = 500) -> DataFrame:
    """Apply `fn` to each task's batches in turn; the rows that it yields are put together in batches."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fn(batches)
        while part := list(islice(made, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def wrapped(x: int) -> int:
    return (x + _HALF) % _WHOLE - _HALF


def _added(a: Column, b: Column) -> Column:
    """Sum modulo 2^64; `b` may be null."""
    wide = F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(str(_WHOLE)).cast("decimal(38,0)"))
    half = F.lit(str(_HALF)).cast("decimal(38,0)")
    return F.when(F.coalesce(b, F.lit(0)) == 0, a).otherwise(
        F.when(wide >= half, wide - F.lit(str(_WHOLE)).cast("decimal(38,0)")).otherwise(wide).cast("long"))
