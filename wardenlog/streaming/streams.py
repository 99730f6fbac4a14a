"""The analytics on streams of events. Every stream reuses the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from .. import schema as S
from ..functions.timeline import find_hot_keys
from ..operators import clean, explain, features, risk, windows
from ..scratch import written
from ..operators.classifier import AttackClassifier
from ..operators.detector import Detector
from ..sources.files import BAD_RECORD, events_csv

EVENT_TIME = "event_time"


def read_event_stream(spark: SparkSession, path: str, file_format: str = "csv", files_per_trigger: int | None = None,
                      header: bool = True, keep_bad: bool = False) -> DataFrame:
    """Stream of labelled raw events from a directory. Quoted CSV fields may hold line breaks; ``keep_bad`` adds the text of
    records with too few or too many fields as ``_bad_record``, for ``accepted_records`` and ``rejected_records``."""
    fields = S.RAW_EVENTS.fields + S.EVENT_LABELS.fields[1:] if file_format == "csv" else S.LABELLED_EVENTS.fields
    if keep_bad and file_format == "csv":
        fields = fields + [StructField(BAD_RECORD, StringType())]
    reader = spark.readStream.schema(StructType(fields)).format(file_format)
    if file_format == "csv":
        reader = reader.options(**events_csv(header=header, keep_bad=keep_bad))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def accepted_records(raw: DataFrame) -> DataFrame:
    return raw.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def rejected_records(raw: DataFrame) -> DataFrame:
    # The reader refuses to parse records for their text alone, so another column is named; it is never used.
    return raw.where(F.col(BAD_RECORD).isNotNull()).select(F.coalesce(BAD_RECORD, "event_id").alias("record"))


def clean_stream(raw: DataFrame) -> DataFrame:
    """Typing, filling, validity and command parsing are row-wise: the batch functions apply as they are."""
    return raw.transform(clean.fix_types).transform(clean.fill_missing).transform(clean.drop_invalid).transform(
        clean.parse_commands
    )


def with_event_time(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Watermark on a timestamp copy of the wall-clock time."""
    return df.withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp")).withWatermark(EVENT_TIME, delay)


def drop_duplicates_stream(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    return with_event_time(df, delay).dropDuplicatesWithinWatermark(["event_id"]).drop(EVENT_TIME)


def hourly_trend(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Anomalies per hour. All events move the watermark, not only anomalies; hours without any have count zero."""
    counts = with_event_time(df, delay).groupBy(F.window(EVENT_TIME, "1 hour")).agg(
        F.count_if(F.col("label") == "anomaly").alias("incidents"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "incidents")


def sliding_failures(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Failed logins per entity in sliding hours, every five minutes; zero for hours of other events only."""
    counts = with_event_time(df, delay).groupBy(F.window(EVENT_TIME, "1 hour", "5 minutes"), "entity_id").agg(
        F.count_if(F.col("auth_status") == "failure").alias("failures")
    )
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "entity_id", "failures"
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a Parquet table."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start().awaitTermination()


def run_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain windows as they change, one directory per batch: open windows are there as well, in their latest state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last state of each window that ``run_updates`` wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def for_each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def baseline_features(batch: DataFrame, baselines: DataFrame, known: DataFrame) -> DataFrame:
    """Novelty and z-scores of a micro-batch against stored baselines."""
    novel = features.novelty(batch, known)
    return features.z_scores(features.attach_baselines(novel, baselines)).drop(*features.baseline_columns(baselines))


class HistoryFeatures:
    """Features that need an entity's history, over micro-batches.

    The state is a pair of tables in shared storage, one directory per batch: the events of the last seven days,
    and the entities' latest events. A batch is computed together with the history it can reach, by the same
    skew-safe operators as the batch job, so a hot entity does not become one state in one task. A repeated batch
    overwrites its own directories and nothing else, so a restart changes no result.
    """

    REACH_DAYS = 7
    HISTORY = [
        "event_id", "timestamp", "entity_id", "source_ip", "auth_status", "bytes_transferred",
        "resource_accessed", "geo_location", "geo_lat", "geo_lon",
    ]
    COLUMNS = ["event_id", "minutes_since_last", "geo_distance_km", "geo_velocity_kmh", *windows.WINDOW_FEATURES]

    def __init__(self, state: str, output: str):
        self.state, self.output = state, output

    def _earlier(self, spark: SparkSession, table: str, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        fields = [f for f in S.EVENTS.fields if f.name in self.HISTORY]
        fields += [StructField("batch", LongType()), StructField("event_date", DateType())]
        stored = spark.read.schema(StructType(fields)).parquet(f"{self.state}/{table}")
        # The latest-event table is complete in every batch; history is the sum of the batches before this one.
        return stored.where(F.col("batch") == batch_id - 1 if table == "latest" else F.col("batch") < batch_id)

    def _store(self, rows: DataFrame, table: str, batch_id: int) -> None:
        dated = rows.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date")
        dated.write.mode("overwrite").partitionBy("event_date").parquet(f"{self.state}/{table}/batch={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A redelivered event counts once: within the batch, and against the history that the batch can reach.
        rows = batch.select(self.HISTORY).dropDuplicates(["event_id"])
        first = rows.agg(F.min("timestamp")).first()[0]
        history, latest = self._earlier(spark, "history", batch_id), self._earlier(spark, "latest", batch_id)
        if first is not None and history is not None:
            stored = history.where(F.col("event_date") >= F.to_date(F.lit(first))).select("event_id")
            rows = written(rows.join(stored, "event_id", "left_anti"), "stream-rows")
        together = rows.withColumn("_new", F.lit(True))
        if first is not None and history is not None:
            reach = F.lit(first) - F.expr(f"INTERVAL {self.REACH_DAYS} DAYS")
            # The date is a partition column: older days are not read.
            recent = history.where((F.col("event_date") >= F.to_date(reach)) & (F.col("timestamp") >= reach))
            # An entity that was silent longer is represented by its latest event only.
            silent = latest.where(F.col("timestamp") < reach)
            together = together.unionByName(recent.unionByName(silent).select(self.HISTORY).withColumn("_new", F.lit(False)))
        hot_entities, hot_ips = find_hot_keys(together, "entity_id"), find_hot_keys(together, "source_ip")
        out = windows.window_features(
            features.travel(together, hot_entities), hot_entities, hot_ips, source=together
        ).where("_new")
        out.select(self.COLUMNS).write.mode("overwrite").parquet(f"{self.output}/batch={batch_id}")

        self._store(rows, "history", batch_id)
        known = rows if latest is None else rows.unionByName(latest.select(self.HISTORY))
        newest = known.groupBy("entity_id").agg(
            F.max(F.struct("timestamp", *[c for c in self.HISTORY if c not in ("timestamp", "entity_id")])).alias("_l")
        )
        self._store(newest.select("entity_id", "_l.*").select(self.HISTORY), "latest", batch_id)


def engineered_batch(
    batch: DataFrame, history: DataFrame, baselines: DataFrame, known: DataFrame, vocabulary: DataFrame
) -> DataFrame:
    """All engineered columns of a micro-batch of cleaned events, from stored tables and its history features."""
    novel = features.attach_baselines(features.novelty(features.calendar(batch), known), baselines)
    rows = (
        novel.transform(features.z_scores)
        .transform(features.commands)
        .transform(features.sensitivity)
        .transform(features.risk_multiplier)
        .transform(features.transfer_rate)
        .transform(features.identity_flags)
        .drop(*features.baseline_columns(baselines))
    )
    return clean.encode_categories(rows.join(history, "event_id"), vocabulary)


class AlertWriter:
    """Score each micro-batch with a stored detector, name its alerts with a stored classifier and write them.

    Neither labels nor attack types of the events are read. ``prepare`` gives a micro-batch's engineered columns.
    """

    def __init__(
        self, detector: Detector, classifier: AttackClassifier, prepare: Callable[[DataFrame, int], DataFrame], path: str
    ):
        self.detector, self.classifier, self.prepare, self.path = detector, classifier, prepare, path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        live = batch.drop(*S.LABEL_COLUMNS)
        scored = self.detector.score(self.prepare(live, batch_id)).where("is_alert = 1")
        named = self.classifier.predict(scored.withColumn("attack_type", F.lit(None).cast("string")))
        rated = risk.composite_risk(named, attack="predicted_attack")
        alerts = explain.recommendation(rated, "predicted_attack").select(
            "event_id", "entity_id", "timestamp", "anomaly_score", "alert_tier", "predicted_attack",
            "classifier_confidence", "risk_score", "risk_level", "recommended_action",
        )
        alerts.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
