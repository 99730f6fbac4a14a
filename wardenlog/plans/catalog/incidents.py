"""Briefs, incident records, lists and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timeline import find_hot_keys
from ...operators import explain, incident
from ...scratch import scratch_path
from ...sources import access_log as source
from ...sources import files
from .alerts import _case
from ... import fixed_values as V
from .identity import NARRATIVE
from .registry import VIEWS, pretty, query, rounded, train_of

_TID = _case("attack_type", {k: v[1] for k, v in V.TECHNIQUES.items()}, V.TECHNIQUE_DEFAULT[1])
_TNAME = _case("attack_type", {k: v[2] for k, v in V.TECHNIQUES.items()}, V.TECHNIQUE_DEFAULT[2])
_BRIEF = f"""
  format('Anomalous access activity detected for user ''{{}}'' in ''{{}}''. Incident flagged as ''{{}}'' targeting resource ''{{}}'' with a Composite Risk Score of {{}}/100 ({{}}).',
    entity_id, department, {pretty("attack_type")}, resource_accessed, risk, tier) AS executive_summary,
  format('The anomaly detection ensemble identified significant behavioral deviations: Access originated from ''{{}}'' using device ''{{}}'' outside historical baseline parameters. Exfiltration volume reached {{:,}} bytes.',
    geo_location, device_fingerprint, bytes_transferred) AS why_detected,
  array_to_string([format('Entity ID: {{}} (Department: {{}})', entity_id, department), 'Source Location: ' || geo_location,
    'Device Identifier: ' || device_fingerprint, 'Target Resource: ' || resource_accessed,
    format('Data Transferred: {{:,}} bytes', bytes_transferred), format('MITRE TTP Alignment: {{}} ({{}})', {_TID}, {_TNAME})], ' | ') AS supporting_evidence,
  CASE WHEN tier = 'CRITICAL' THEN format('HIGH BUSINESS IMPACT. Potential compromise of confidential {{}} data and unauthorized access to critical infrastructure resource ''{{}}''. Regulatory exposure under GDPR / ISO 27001.', department, resource_accessed)
    ELSE 'MODERATE BUSINESS IMPACT. Requires analyst verification to prevent potential unauthorized lateral movement.' END AS business_impact,
  format('Disable-LocalUser -Name ''{{}}''; Revoke-AzureADUserAllRefreshToken -ObjectId ''{{}}''', entity_id, entity_id) AS powershell"""
_BRIEF_COLUMNS = ["executive_summary", "why_detected", "supporting_evidence", "business_impact", "powershell"]


@query("e5_investigation_brief", f"SELECT event_id, {_BRIEF} FROM (SELECT *, '88.5' AS risk, 'CRITICAL' AS tier FROM log WHERE label = 'anomaly') q")
def e5(spark, sf_dir):
    log = source.access_log(spark, sf_dir).where(F.col("label") == "anomaly")
    brief = explain.investigation_brief(log)
    return brief.withColumn("supporting_evidence", F.array_join("supporting_evidence", " | ")).select(
        "event_id", *_BRIEF_COLUMNS
    )


_DEPT = _case("upper(dept)", V.DEPARTMENT_SENSITIVITY, 0.5)
_RES = _case("replace(upper(resource_category), ' ', '_')", V.RESOURCE_SENSITIVITY, 0.5)
VIEWS["assessed"] = f"""
SELECT *, least(100.0, weighted * 100.0 * (1.0 + least(repeats - 1, 5) * CAST(0.08 AS DOUBLE))) AS risk_raw
FROM (
  SELECT d.*, l.resource_category, greatest(1, CAST(w.repeat_anomalies_24h AS BIGINT)) AS repeats,
    CAST(least(1.0, greatest(0.0, round(deviation_raw, 1) / 100.0)) AS DOUBLE) * CAST(0.20 AS DOUBLE) + CAST(0.85 AS DOUBLE) * CAST(0.15 AS DOUBLE)
    + CAST({_DEPT} AS DOUBLE) * CAST(0.10 AS DOUBLE) + CAST({_RES} AS DOUBLE) * CAST(0.15 AS DOUBLE)
    + CAST(CASE WHEN d.hr < 7 OR d.hr > 19 THEN 1.0 ELSE 0.2 END AS DOUBLE) * CAST(0.10 AS DOUBLE)
    + CAST(CASE WHEN d.attack_type = 'impossible_travel' THEN 1.0 ELSE 0.0 END AS DOUBLE) * CAST(0.07 AS DOUBLE)
    + CAST(0.2 AS DOUBLE) * CAST(0.05 AS DOUBLE)
    + CAST(least(1.0, (greatest(1, CAST(w.repeat_anomalies_24h AS BIGINT)) - 1) / 5.0) AS DOUBLE) * CAST(0.10 AS DOUBLE) AS weighted
  FROM deviated d JOIN (SELECT event_id, resource_category FROM log) l USING (event_id)
  JOIN (SELECT event_id, repeat_anomalies_24h FROM windowed) w USING (event_id) WHERE d.label = 'anomaly') q"""
VIEWS["incident"] = f"""
SELECT a.event_id AS incident_id, a.timestamp, a.entity_id AS user, dept AS department, entity_role AS role, device_fingerprint AS device,
  geo_location AS location, {pretty("attack_type")} AS attack_type, round(deviation_raw, 6) AS deviation_raw, round(risk_raw, 6) AS risk_raw,
  repeats, total_stages, s.highest_severity, {NARRATIVE.replace("entity_id", "a.entity_id")} AS attack_narrative,
  'OPEN' AS incident_status
FROM assessed a JOIN storied s ON s.entity_id = a.entity_id"""


def _log_hot(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return log, train_of(log), find_hot_keys(log, "entity_id")


@query("n1_incidents", """
SELECT incident_id, timestamp, user, department, role, device, location, attack_type, total_stages, highest_severity, attack_narrative,
  incident_status FROM incident""")
def n1(spark, sf_dir):
    records = incident.incidents(*_log_hot(spark, sf_dir))
    return records.select(
        "incident_id", "timestamp", "user", "department", "role", "device", "location", "attack_type",
        "storyline.total_stages", "storyline.highest_severity", "storyline.attack_narrative", "incident_status",
    )


@query("n1_assessment", """
SELECT event_id, repeats AS repeat_count, round(deviation_raw, 6) AS deviation_raw, round(risk_raw, 6) AS dynamic_risk_raw FROM assessed""")
def n1_assessment(spark, sf_dir):
    out = incident.assessed(*_log_hot(spark, sf_dir))
    return rounded(out, "deviation_raw", "dynamic_risk_raw").select(
        "event_id", "repeat_count", "deviation_raw", "dynamic_risk_raw"
    )


@query("n2_incident_list", "SELECT count(*) AS incidents, count(DISTINCT user) AS users, min(incident_id) AS first_id FROM incident")
def n2(spark, sf_dir):
    records = incident.incident_list(incident.incidents(*_log_hot(spark, sf_dir)))
    return records.agg(F.count(F.lit(1)).alias("incidents"), F.count_distinct("user").alias("users"),
                       F.min("incident_id").alias("first_id"))


@query("n2_incident_timeline", """
SELECT i.incident_id, s.event_id, s.step_number, s.stage_title FROM staged s JOIN incident i ON i.user = s.entity_id
WHERE i.incident_id = 'evt-00000125'""")
def n2_timeline(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    own = incident.events_of_incident(log, "evt-00000125")
    rows = incident.timeline_of(log, "evt-00000125", find_hot_keys(own, "entity_id"))
    return rows.select("incident_id", "event_id", "step_number", "stage_title")


@query("snk5_incident_reports", f"""
SELECT event_id, entity_id, attack_type AS threat_category, 'Confirmed Threat' AS assessment, executive_summary
FROM (SELECT event_id, entity_id, attack_type, {_BRIEF} FROM (SELECT *, '88.5' AS risk, 'CRITICAL' AS tier FROM log WHERE label = 'anomaly') q) r""")
def snk5(spark, sf_dir):
    log = source.access_log(spark, sf_dir).where(F.col("label") == "anomaly")
    path = scratch_path(spark, "reports")
    files.write_reports(incident.reports(log, "Confirmed Threat", "checked"), path)
    fields = "event_id string, entity_id string, threat_category string, assessment string, investigation_brief struct<executive_summary string>"
    return spark.read.text(path).select(F.from_json("value", fields).alias("r")).select(
        "r.event_id", "r.entity_id", "r.threat_category", "r.assessment", "r.investigation_brief.executive_summary"
    )
