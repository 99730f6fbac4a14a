"""Rows as packed blocks of numbers, a whole copy of them for each of some tasks.

For models whose parts are grown side by side from the same rows: a copy goes through a shuffle, never through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def slots(spark: SparkSession) -> int:
    """Tasks that run at the same time; 1 where executors come and go, as a barrier cannot count on them."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def packed_rows(rows: DataFrame, parts: Callable[[pa.RecordBatch], Sequence[np.ndarray]]) -> DataFrame:
    """One row for each Arrow batch: the bytes of the arrays that ``parts`` makes of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([[np.ascontiguousarray(p).tobytes() for p in parts(batch)]], pa.list_(pa.binary()))], ["block"])

    return rows.mapInArrow(run, "block array<binary>")


def unpacked(batches: Iterator[pa.RecordBatch], kinds: Sequence[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of all blocks, one below the other; ``kinds`` has type and width of each."""
    blocks = [block for batch in batches for block in batch.column("block").to_pylist()]
    return [np.concatenate([np.zeros((0, width), kind), *(np.frombuffer(b[i], kind).reshape(-1, width) if width else np.zeros((0, 0), kind) for b in blocks)])
            for i, (kind, width) in enumerate(kinds)]


def to_each_task(blocks: DataFrame, tasks: int) -> DataFrame:
    """All blocks in each of ``tasks`` partitions."""
    return blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")).repartitionById(tasks, "task")
