"""Incident records: identity, dynamic risk, storyline and brief of each anomaly in one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import pretty, thousands
from ..functions.timeline import HotKeys
from . import explain, identity, risk, storyline
from .reports import anomalies
from .windows import repeat_anomalies


def assessed(df: DataFrame, history: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Anomalies with repeat count, identity deviation and the dynamic risk that it feeds."""
    # Only anomalies are counted, so the rest of the log need not be ordered.
    counted = repeat_anomalies(anomalies(df), hot)
    return identity.deviation(counted, history).transform(risk.dynamic_risk)


def opened(df: DataFrame) -> DataFrame:
    """Id and initial status of every incident, for triage: no record need be built for these."""
    return anomalies(df).select(F.col("event_id").alias("incident_id"), F.lit("OPEN").alias("incident_status"))


def incidents(df: DataFrame, history: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One nested record per anomaly.

    The storyline enters as the entity's summary. Its stages are one table per log, keyed by entity; nesting
    them into every incident would repeat an entity's history once per anomaly. ``incident_timeline`` joins them
    for one incident.
    """
    briefed = explain.investigation_brief(assessed(df, history, hot))
    story = storyline.summaries(df)
    out = briefed.join(story, "entity_id", "left")
    pct = F.format_string("%.1f", "deviation_percentage")
    evidence = F.array(
        F.concat(F.lit("Country / Location Shift: "), "geo_location"),
        F.concat(F.lit("Device Fingerprint Deviation: "), "device_fingerprint"),
        F.lit("Outside Working Hours: Access logged at off-hours window"),
        F.concat(F.lit("Sensitive Resource Targeted: "), "resource_accessed"),
        F.concat(F.lit("Exfiltration Data Burst: "), thousands(F.col("bytes_transferred")), F.lit(" bytes")),
    )
    return out.select(
        F.col("event_id").alias("incident_id"), "timestamp", F.col("entity_id").alias("user"), "department",
        F.col("entity_role").alias("role"), F.col("device_fingerprint").alias("device"),
        F.col("geo_location").alias("location"),
        F.col("composite_risk_score").alias("risk_score"), F.col("copilot_confidence_pct").alias("confidence"),
        F.col("risk_tier").alias("severity"), pretty("attack_type").alias("attack_type"),
        evidence.alias("evidence"),
        F.struct(
            F.struct("hour_low", "hour_high", F.round("login_frequency", 1).alias("login_frequency"),
                     F.round("avg_session_duration", 1).alias("avg_session_duration"),
                     F.round("avg_bytes_transferred", 1).alias("avg_bytes_transferred"),
                     "total_historical_events", "typical_countries").alias("historical"),
            F.col("device_fingerprint").alias("current_device"), F.col("geo_location").alias("current_country"),
            F.col("timestamp").alias("current_login_time"), F.col("resource_accessed").alias("current_resource"),
            F.col("deviation_percentage").alias("behavior_deviation_score"),
            F.format_string("Current behavior deviates significantly (%s%%) from historical baseline.", pct).alias(
                "deviation_summary"),
        ).alias("behavior_profile"),
        F.struct("total_stages", "highest_severity", "attack_narrative").alias("storyline"),
        F.struct("executive_summary", "business_impact", "risk_explanation", "recommended_actions",
                 F.col("powershell").alias("powershell_remediation")).alias("recommendations"),
        F.struct(F.lit("OPEN").alias("status"), F.lit("UNASSIGNED").alias("assessment"),
                 F.array().cast("array<string>").alias("comments")).alias("analyst_feedback"),
        F.lit("OPEN").alias("incident_status"), F.lit("Pending Triage").alias("resolution"),
    )


def incident_list(records: DataFrame) -> DataFrame:
    return records.select("incident_id", "timestamp", "user", "severity", "attack_type", "incident_status")


def incident_by_id(records: DataFrame, incident_id: str) -> DataFrame:
    return records.where(F.col("incident_id") == incident_id)


def incident_timeline(records: DataFrame, stage_rows: DataFrame, incident_id: str) -> DataFrame:
    """Stages of the entity of one incident, one row each."""
    user = incident_by_id(records, incident_id).select("incident_id", F.col("user").alias("entity_id"))
    return stage_rows.join(user, "entity_id")


def events_of_incident(df: DataFrame, incident_id: str) -> DataFrame:
    """The events of the entity of one incident. The id reaches the scan, and its one entity the other scan as a runtime filter."""
    owner = anomalies(df).where(F.col("event_id") == incident_id).select(F.col("entity_id").alias("_owner")).distinct()
    return df.join(owner, F.col("entity_id") == F.col("_owner"), "left_semi")


def timeline_of(df: DataFrame, incident_id: str, hot: HotKeys | None = None) -> DataFrame:
    """As ``incident_timeline``, from the log: no other incident and no other entity's stages are built.

    ``hot`` is found on ``events_of_incident``.
    """
    return storyline.stages(events_of_incident(df, incident_id), hot).withColumn("incident_id", F.lit(incident_id))


def combined_alerts(alert_rows: DataFrame, assessed_rows: DataFrame) -> DataFrame:
    """Alert payload with the dynamic-risk and identity results of the same event."""
    extra = identity.deviation_details(assessed_rows).select(
        "event_id",
        F.struct("composite_risk_score", "risk_tier", "risk_color", "velocity_multiplier",
                 F.col("repeat_count").alias("repeat_anomalies_24h"), "risk_explanation", "recommended_soc_action",
                 risk.factor_breakdown().alias("factor_breakdown")).alias("dynamic_risk_engine"),
        F.struct("deviation_percentage", "behavior_summary", "top_deviations", "risk_contributions",
                 "human_explanation").alias("behavioral_identity_engine"),
    )
    return alert_rows.join(extra, "event_id")


def reports(df: DataFrame, assessment: str, notes: str) -> DataFrame:
    """Export form: one JSON document per incident with its brief."""
    brief = explain.investigation_brief(df)
    document = F.struct(
        "event_id", "entity_id", "timestamp", F.col("attack_type").alias("threat_category"),
        F.lit(assessment).alias("assessment"), F.lit(notes).alias("analyst_notes"),
        F.struct(*explain.BRIEF_COLUMNS,
                 F.struct("tactic", "technique_id", "technique_name", "technique_url").alias("mitre_attack_mapping"),
                 ).alias("investigation_brief"),
    )
    return brief.select("event_id", F.to_json(document).alias("report"))
