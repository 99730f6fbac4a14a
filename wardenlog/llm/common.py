"""What the operators share: reading, row keys, batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import apply_settings

#: Texts that a task holds at once, in bytes; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20

#: Texts are long: small batches keep what the JVM and a Python worker hold of them small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def settled(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def text_hash(text: Column) -> Column:
    """Tells apart the texts of rows that carry the same id."""
    return F.xxhash64(text)


def carried(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row as one struct `row`, beside its join keys; column names of the row cannot clash with those of a result."""
    return df.select(
        F.struct(*[column(c) for c in df.columns]).alias("row"),
        column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"),
    )


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.thash == b.thash)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, heavy: str | None = None) -> DataFrame:
    """Apply `fn` to batches of columns as Python lists, at most about BATCH_BYTES of the column `heavy` at a time."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, heavy):
                cols = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def pieces(batch: pa.RecordBatch, heavy: str | None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose heavy column holds about BATCH_BYTES each."""
    n = batch.num_rows
    if heavy is None or n == 0:
        yield batch
        return
    step = max(1, int(n * BATCH_BYTES / max(batch.column(batch.schema.get_field_index(heavy)).nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def utf8(text: Column) -> Column:
    """The text's bytes, so that tasks need not decode them."""
    return text.cast("binary")
