"""Triage queries over the audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timeline import find_hot_keys
from ...operators import incident, triage
from ...scratch import scratch_path, written
from ...sources import access_log as source
from .registry import VIEWS, query

VIEWS["latest_action"] = """
SELECT incident_id, status, last_updated, updated_by FROM (
  SELECT incident_id, new_status AS status, timestamp AS last_updated, analyst AS updated_by,
    row_number() OVER (PARTITION BY incident_id ORDER BY timestamp DESC, new_status DESC) AS k FROM audit) q WHERE k = 1"""
VIEWS["feedback"] = """
SELECT incident_id, trim(string_agg(remarks, ' | ' ORDER BY timestamp), ' |') AS analyst_feedback FROM audit WHERE remarks <> '' GROUP BY 1"""


def _log_audit(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return log, source.audit(log)


@query("g1_record_actions", "SELECT timestamp, incident_id, previous_status, new_status, analyst, remarks FROM audit")
def g1(spark, sf_dir):
    log, audit = _log_audit(spark, sf_dir)
    requests = audit.drop("previous_status")
    return triage.record_actions(requests, log, find_hot_keys(requests, "incident_id"))


@query("g2_apply_actions", """
SELECT l.event_id, coalesce(a.status, CASE WHEN label = 'anomaly' THEN 'LIVE_THREAT' ELSE 'BENIGN' END) AS status,
  coalesce(strftime(last_updated, '%Y-%m-%d %H:%M:%S'), '') AS last_updated, coalesce(updated_by, '') AS updated_by
FROM log l LEFT JOIN latest_action a ON a.incident_id = l.event_id""")
def g2(spark, sf_dir):
    return triage.apply_actions(*_log_audit(spark, sf_dir)).select("event_id", "status", "last_updated", "updated_by")


@query("g2_snapshot_and_delta", """
SELECT l.event_id, coalesce(a.status, CASE WHEN label = 'anomaly' THEN 'LIVE_THREAT' ELSE 'BENIGN' END) AS status,
  coalesce(strftime(last_updated, '%Y-%m-%d %H:%M:%S'), '') AS last_updated, coalesce(updated_by, '') AS updated_by,
  CASE WHEN a.incident_id IS NULL THEN label WHEN a.status IN ('FALSE_POSITIVE', 'RESOLVED') THEN 'normal' ELSE 'anomaly' END AS label,
  CASE WHEN EXISTS (SELECT 1 FROM audit x WHERE x.incident_id = l.event_id AND x.new_status IN ('FALSE_POSITIVE', 'RESOLVED')) THEN 'normal' ELSE attack_type END AS attack_type,
  coalesce(analyst_feedback, '') AS analyst_feedback
FROM log l LEFT JOIN latest_action a ON a.incident_id = l.event_id LEFT JOIN feedback f ON f.incident_id = l.event_id""")
def g2_snapshot(spark, sf_dir):
    """Two parts of the audit trail, of whole days: one as stored state, the other as actions; remarks are appended by both."""
    log, audit = _log_audit(spark, sf_dir)
    first = F.dayofmonth("timestamp") % 2 == 0
    stored = written(triage.snapshot(audit.where(first)), "audit-state")
    chunks = scratch_path(spark, "remarks")
    for part in (first, ~first):
        triage.remark_chunks(audit.where(part)).write.mode("append").parquet(chunks)
    state = triage.merge_snapshots(stored, triage.snapshot(audit.where(~first)))
    texts = triage.feedback_of_chunks(spark.read.parquet(chunks))
    return triage.with_state(log, triage.current_state(state, texts)).select(
        "event_id", "status", "last_updated", "updated_by", "label", "attack_type", "analyst_feedback")


@query("g3_feedback_texts", "SELECT incident_id, analyst_feedback FROM feedback")
def g3(spark, sf_dir):
    return triage.feedback_texts(_log_audit(spark, sf_dir)[1])


@query("g3_remark_chunks", """
SELECT incident_id, CAST(event_date AS VARCHAR) AS event_date, chunk, count(*) AS remarks, string_agg(text, ' | ' ORDER BY k) AS remark_text FROM (
  SELECT incident_id, event_date, k, remarks AS text, (k - 1) // 2 AS chunk FROM (
    SELECT *, CAST(timestamp AS DATE) AS event_date,
      row_number() OVER (PARTITION BY incident_id, CAST(timestamp AS DATE) ORDER BY timestamp, new_status, remarks) AS k
    FROM audit WHERE remarks <> '') q) r GROUP BY 1, 2, 3""")
def g3_chunks(spark, sf_dir):
    audit = _log_audit(spark, sf_dir)[1]
    dated = audit.withColumn("event_date", F.to_date("timestamp"))
    chunks = triage.remark_chunks(audit, 2, find_hot_keys(dated, ["incident_id", "event_date"]))
    return chunks.withColumn("event_date", F.col("event_date").cast("string"))


@query("g4_relabel", """
SELECT l.event_id, CASE WHEN a.incident_id IS NULL THEN label WHEN a.status IN ('FALSE_POSITIVE', 'RESOLVED') THEN 'normal' ELSE 'anomaly' END AS label,
  CASE WHEN EXISTS (SELECT 1 FROM audit x WHERE x.incident_id = l.event_id AND x.new_status IN ('FALSE_POSITIVE', 'RESOLVED')) THEN 'normal' ELSE attack_type END AS attack_type
FROM log l LEFT JOIN latest_action a ON a.incident_id = l.event_id""")
def g4(spark, sf_dir):
    return triage.apply_actions(*_log_audit(spark, sf_dir)).select("event_id", "label", "attack_type")


@query("g5_feedback_status", """
SELECT incident_id, timestamp, CASE WHEN new_status = 'FALSE_POSITIVE' THEN 'False Positive' ELSE 'Confirmed Attack' END AS feedback,
  CASE new_status WHEN 'FALSE_POSITIVE' THEN 'FALSE_POSITIVE' WHEN 'RESOLVED' THEN 'RESOLVED'
    WHEN 'UNDER_INVESTIGATION' THEN 'UNDER_INVESTIGATION' ELSE 'CONFIRMED_THREAT' END AS code FROM audit""")
def g5(spark, sf_dir):
    audit = _log_audit(spark, sf_dir)[1]
    shown = F.when(F.col("new_status") == "FALSE_POSITIVE", "False Positive (Close Alert)").otherwise(
        F.initcap(F.replace("new_status", F.lit("_"), F.lit(" "))))
    return audit.select(
        "incident_id", "timestamp", triage.feedback_status(F.col("new_status") == "FALSE_POSITIVE").alias("feedback"),
        triage.status_code(shown).alias("code"),
    )


@query("g6_triage_incidents", """
SELECT i.incident_id, coalesce(a.status, 'OPEN') AS incident_status, coalesce(f.analyst_feedback, '') AS comments,
  coalesce(a.updated_by, 'UNASSIGNED') AS assessed_by
FROM incident i LEFT JOIN latest_action a USING (incident_id) LEFT JOIN feedback f USING (incident_id)""")
def g6(spark, sf_dir):
    log, audit = _log_audit(spark, sf_dir)
    return triage.triage_incidents(incident.opened(log), audit).select("incident_id", "incident_status", "comments", "assessed_by")
