"""Adapter: the ``events`` table of the test data seen as an enterprise access log.

Pure projections over one Parquet table, in SQL that Spark and other ANSI engines read alike, so the same
text serves as a view here and as a common table expression in the checks. Column pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _access_log_sql as sql


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled access log: the 23 event columns followed by the three label columns."""
    return from_events(events(spark, sf_dir))


def from_events(raw: DataFrame) -> DataFrame:
    return raw.sparkSession.sql(sql.ACCESS_LOG.replace("FROM events)", "FROM {events})"), events=raw)


def scored(log: DataFrame) -> DataFrame:
    """Deterministic stand-in for model output, one row per event."""
    return log.sparkSession.sql(sql.SCORED.replace("FROM access_log)", "FROM {access_log})"), access_log=log)


def audit(log: DataFrame) -> DataFrame:
    """Triage actions on the anomalies of the log, shaped like the audit trail."""
    return log.sparkSession.sql(sql.AUDIT.replace("FROM access_log ", "FROM {access_log} "), access_log=log)
