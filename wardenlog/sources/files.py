"""File sources and sinks. Schemas are fixed; a missing audit log is an empty frame."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from .. import fixed_values as V
from .. import schema as S
from ..scratch import scratch_path

# Quotes inside quoted fields are doubled, as spreadsheet tools and most CSV writers do.
CSV = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    # A file whose header does not match the schema is refused, not read by position.
    "enforceSchema": "false",
}
# Quoted fields may hold line breaks. Files are then read whole, each by one task, so they should be of a block's size or two.
WHOLE_CSV = CSV | {"multiLine": "true"}
#: Text of a record with fewer or more fields than the schema, null for all others.
BAD_RECORD = "_bad_record"


def events_csv(line_breaks: bool = True, header: bool = True, keep_bad: bool = False) -> dict[str, str]:
    """Options of a reader of CSV events."""
    options = (WHOLE_CSV if line_breaks else CSV) | {"header": str(header).lower()}
    return options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD} if keep_bad else options


def read_events(spark: SparkSession, path: str, file_format: str = "csv", line_breaks: bool = True, header: bool = True,
                keep_bad: bool = False) -> DataFrame:
    """Raw access log. CSV fields stay text for the typing step; Parquet has the typed schema.

    Very large CSV files without line breaks in fields are split between tasks with ``line_breaks=False``. ``keep_bad`` adds
    the column ``_bad_record``, for ``split_records``; without it, what a short record lacks is null and what a long one has
    too much is ignored.
    """
    if file_format != "csv":
        return spark.read.schema(S.EVENTS).format(file_format).load(path)
    schema = T.StructType(S.RAW_EVENTS.fields + [T.StructField(BAD_RECORD, T.StringType())] * keep_bad)
    return spark.read.schema(schema).options(**events_csv(line_breaks, header, keep_bad)).csv(path)


def split_records(events: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Accepted rows, rejected records (``record``, the text) and the numbers of both, of events read with ``keep_bad``.

    The text is parsed once: both kinds are written in that pass, each into directories of its own, and counted on the way.
    """
    spark, path, counted = events.sparkSession, scratch_path(events.sparkSession, "records"), Observation()
    bad = F.col(BAD_RECORD).isNotNull()
    flagged = events.withColumn("_rejected", bad).observe(counted, F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    flagged.write.partitionBy("_rejected").parquet(path)
    both = spark.read.schema(flagged.schema).parquet(path)
    accepted = both.where(~F.col("_rejected")).drop("_rejected", BAD_RECORD)
    return accepted, both.where("_rejected").select(F.col(BAD_RECORD).alias("record")), counted.get


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EVENT_LABELS).options(**CSV).csv(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Entity profiles; list literals become arrays."""
    raw = spark.read.schema(S.RAW_PROFILES).options(**CSV).csv(path)
    strings, ints = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
    return raw.withColumns({
        "work_days": F.from_json("work_days", ints),
        "known_devices": F.from_json("known_devices", strings),
        "typical_resources": F.from_json("typical_resources", strings),
    })


def read_engineered(spark: SparkSession, path: str) -> DataFrame:
    """Engineered data set; only the columns and days a query uses are read."""
    return spark.read.parquet(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(S.AUDIT).options(**WHOLE_CSV).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], S.AUDIT)
        raise


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.PLACES, "geo_location string, geo_lat double, geo_lon double")


def resources(spark: SparkSession) -> DataFrame:
    rows = [(c, r) for c, names in V.RESOURCES.items() for r in names]
    return spark.createDataFrame(rows, "resource_category string, resource string")


def user_agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.USER_AGENTS.items()), "device_os string, user_agent string")


def write_engineered(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite") -> None:
    """Engineered data set by event date. CSV cannot hold arrays, so they are written as JSON text.

    The rebalance hint gathers a day's rows into few files and splits a busy day over several tasks.
    """
    dated = df.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date")
    if file_format == "csv":
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        dated.withColumns({c: F.to_json(c) for c in arrays}).write.mode(mode).partitionBy("event_date").options(**CSV).csv(path)
    else:
        dated.write.mode(mode).partitionBy("event_date").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select(S.AUDIT.names).write.mode("append").options(**WHOLE_CSV).csv(path)


def export_csv(events: DataFrame, labels: DataFrame, profiles: DataFrame, path: str) -> None:
    """Events, labels and profiles as three CSV directories; list columns as JSON text."""
    for name, df in (("events", events), ("labels", labels), ("entity_profiles", profiles)):
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        df.withColumns({c: F.to_json(c) for c in arrays}).write.mode("overwrite").options(**CSV).csv(f"{path}/{name}")


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per line."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_text_report(lines: DataFrame, path: str) -> None:
    """Lines of a report as text, in the order of their sections; a report is a few lines for each class and feature."""
    headed = lines.select(F.struct("place", F.lit(1).alias("part"), "item").alias("at"), "line").unionByName(
        lines.select("place", "section").distinct().select(
            F.struct("place", F.lit(0).alias("part"), F.lit("").alias("item")).alias("at"), F.concat(F.lit("== "), "section", F.lit(" ==")).alias("line")))
    headed.coalesce(1).sortWithinPartitions("at").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
