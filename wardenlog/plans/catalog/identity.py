"""Identity profiles, deviations, storylines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timeline import find_hot_keys
from ...operators import identity, storyline
from ...sources import access_log as source
from .registry import VIEWS, joined, joined_sql, pretty, query, rounded, train_of


def _profile_view(rows: str) -> str:
    return f"""
SELECT entity_id, arg_min(department, (timestamp, event_id)) AS department,
  CAST(floor(quantile_cont(hr, 0.1)) AS BIGINT) AS hour_low, CAST(floor(quantile_cont(hr, 0.9)) AS BIGINT) AS hour_high,
  count(*) / greatest(1, (max(us) - min(us)) // 86400000000) AS login_frequency,
  avg(session_duration) AS avg_session_duration, avg(bytes_transferred) AS avg_bytes_transferred,
  count(*) AS total_historical_events,
  array_to_string(list_sort(list(DISTINCT device_fingerprint)), ' | ') AS typical_devices,
  array_to_string(list_sort(list(DISTINCT geo_location)), ' | ') AS typical_countries,
  array_to_string(list_sort(list(DISTINCT resource_accessed)), ' | ') AS normal_resources,
  array_to_string(list_sort(list(DISTINCT action_type)), ' | ') AS normal_commands
FROM {rows} GROUP BY entity_id"""


VIEWS["profile_all"] = _profile_view("log")
VIEWS["profile_train"] = _profile_view("train")
_SETS = ["typical_devices", "typical_countries", "normal_resources", "normal_commands"]
_NUM = ["login_frequency", "avg_session_duration", "avg_bytes_transferred"]


@query("i1_profiles", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _NUM)}) FROM profile_all")
def i1(spark, sf_dir):
    out = identity.build_profiles(source.access_log(spark, sf_dir))
    return rounded(out, *_NUM).withColumns({c: F.array_join(c, " | ") for c in _SETS})


@query("i2_profile_lookup", """
SELECT e.entity_id, coalesce(department, 'Unknown') AS department, coalesce(hour_low, 8) AS hour_low, coalesce(hour_high, 18) AS hour_high,
  round(coalesce(login_frequency, 10.0), 6) AS login_frequency, coalesce(typical_countries, 'US') AS typical_countries,
  coalesce(normal_commands, 'read') AS normal_commands, round(coalesce(avg_session_duration, 30.0), 6) AS avg_session_duration,
  round(coalesce(avg_bytes_transferred, 1000.0), 6) AS avg_bytes_transferred, coalesce(total_historical_events, 0) AS total_historical_events
FROM (SELECT DISTINCT entity_id FROM log) e LEFT JOIN profile_train p USING (entity_id)""")
def i2(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    found = identity.lookup_profiles(log.select("entity_id").distinct(), identity.build_profiles(train_of(log)))
    return rounded(found, *_NUM).select(
        "entity_id", "department", "hour_low", "hour_high", "login_frequency", joined("typical_countries"),
        joined("normal_commands"), "avg_session_duration", "avg_bytes_transferred",
        F.col("total_historical_events").cast("bigint").alias("total_historical_events"),
    )


def _seen(kind: str, column: str, default: str) -> str:
    return (f"CASE WHEN total_historical_events IS NULL THEN {column} <> '{default}' ELSE NOT EXISTS (SELECT 1 FROM known k "
            f"WHERE k.entity_id = l.entity_id AND k.kind = '{kind}' AND k.value = l.{column}) END")


VIEWS["judged"] = f"""
SELECT event_id, entity_id, timestamp, hr, label, attack_type, geo_location, device_fingerprint, resource_accessed, bytes_transferred,
  entity_role, dept, lo, hi, mean_round, typical_countries_join, unusual_geo, unusual_device, unusual_resource,
  CASE WHEN hr < lo OR hr > hi THEN least(1.0, least(abs(hr - lo), abs(hr - hi)) / 6.0) ELSE 0.0 END AS p_hours,
  hr < lo OR hr > hi AS off_profile, bytes_transferred > mean_round * 3.0 AS exceeded,
  round(bytes_transferred / greatest(1.0, mean_round), 1) AS times_mean
FROM (
  SELECT l.*, l.department AS dept, coalesce(hour_low, 8) AS lo, coalesce(hour_high, 18) AS hi,
    round(coalesce(avg_bytes_transferred, 1000.0), 1) AS mean_round,
    coalesce(replace(typical_countries, ' | ', ', '), 'US') AS typical_countries_join,
    {_seen("geo", "geo_location", "US")} AS unusual_geo,
    {_seen("device", "device_fingerprint", "Corporate-Standard")} AS unusual_device,
    {_seen("resource", "resource_accessed", "General-App")} AS unusual_resource
  FROM log l LEFT JOIN (SELECT * EXCLUDE (department) FROM profile_train) p USING (entity_id)) l"""
VIEWS["deviated"] = """
SELECT *, (p_hours * 20.0 + CASE WHEN unusual_geo THEN 25.0 ELSE 0.0 END + CASE WHEN unusual_device THEN 15.0 ELSE 0.0 END
  + CASE WHEN unusual_resource THEN 20.0 ELSE 0.0 END + p_volume * 20.0) / 100.0 * 100.0 AS deviation_raw
FROM (SELECT *, CASE WHEN exceeded THEN least(1.0, (times_mean - 1.0) / 10.0) ELSE 0.0 END AS p_volume FROM judged) q"""


def _deviated(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return identity.deviation(log, train_of(log))


@query("i3_deviation", """
SELECT event_id, round(p_hours * 20.0, 6) AS c_off_hours_access, CASE WHEN unusual_geo THEN 25.0::DOUBLE ELSE 0.0 END AS c_unusual_location,
  CASE WHEN unusual_device THEN 15.0::DOUBLE ELSE 0.0 END AS c_unrecognized_device,
  CASE WHEN unusual_resource THEN 20.0::DOUBLE ELSE 0.0 END AS c_sensitive_resource_access,
  round(p_volume * 20.0, 6) AS c_abnormal_data_volume, round(deviation_raw, 6) AS deviation_raw FROM deviated""")
def i3(spark, sf_dir):
    out = _deviated(spark, sf_dir)
    return rounded(out, "deviation_raw", *[f"c_{k}" for k in identity.CHECKS]).select(
        "event_id", "deviation_raw", *[f"c_{k}" for k in identity.CHECKS]
    )


@query("i4_deviation_details", f"""
SELECT event_id, {joined_sql([
    "CASE WHEN off_profile THEN 'Off-Hours Access: ' || CASE WHEN p_hours > 0.6 THEN 'High' ELSE 'Medium' END || ': ' || format('Access at {:02d}:00 outside baseline working hours ({:02d}:00–{:02d}:00)', hr, lo, hi) END",
    "CASE WHEN unusual_geo THEN 'Unusual Geographic Location: Critical: Access from ''' || geo_location || ''' not in typical country list (' || typical_countries_join || ')' END",
    "CASE WHEN unusual_device THEN 'Unrecognized Device: Medium: Device ''' || device_fingerprint || ''' not in baseline approved devices' END",
    "CASE WHEN unusual_resource THEN 'Unusual Resource Access: High: Resource ''' || resource_accessed || ''' never accessed previously by this user' END",
    "CASE WHEN exceeded THEN 'Abnormal Data Volume Exfiltration: ' || CASE WHEN times_mean > 5.0 THEN 'Critical' ELSE 'High' END || format(': Transferred {:,} bytes ({:.1f}x higher than baseline mean of {:,} bytes)', bytes_transferred, times_mean, CAST(round_even(mean_round, 0) AS BIGINT)) END",
])} AS details FROM deviated""")
def i4(spark, sf_dir):
    out = identity.deviation_details(_deviated(spark, sf_dir))
    lines = F.transform("top_deviations", lambda d: F.concat(d["factor"], F.lit(": "), d["severity"], F.lit(": "), d["detail"]))
    return out.select("event_id", F.array_join(lines, " | ").alias("details"))


@query("i5_deviation_bands", """
SELECT CASE WHEN deviation_raw > 50 THEN 'high' WHEN deviation_raw > 25 THEN 'medium' ELSE 'low' END AS band, count(*) AS events
FROM deviated GROUP BY 1""")
def i5(spark, sf_dir):
    band = identity.deviation_band(F.col("deviation_raw")).alias("band")
    return _deviated(spark, sf_dir).groupBy(band).agg(F.count(F.lit(1)).alias("events"))


# --- Storylines ---------------------------------------------------------------------------------------

_SEVERITY = "CASE WHEN label = 'anomaly' AND attack_type IN ('lateral_movement', 'low_slow_exfiltration') THEN 'CRITICAL' WHEN label = 'anomaly' THEN 'HIGH' ELSE 'INFO' END"
_TITLE = """CASE WHEN attack_type = 'impossible_travel' THEN 'Stage 2: Geo-Velocity Anomaly'
  WHEN action_type = 'login' THEN 'Stage 1: Authentication & Entry'
  WHEN label = 'anomaly' THEN 'Stage ' || CAST(least(5, step_number) AS VARCHAR) || ': Behavioral Anomaly Detected'
  ELSE 'Stage ' || CAST(least(5, step_number) AS VARCHAR) || ': Baseline Telemetry Log' END"""
VIEWS["staged"] = f"""
SELECT entity_id, event_id, timestamp, step_number, {_TITLE} AS stage_title, {pretty("action_type")} AS action,
  {pretty("attack_type")} AS attack_vector, {_SEVERITY} AS severity,
  {joined_sql(["'Geo Location: ' || geo_location", "'Device Fingerprint: ' || device_fingerprint",
               "'Resource Target: ' || resource_accessed",
               "CASE WHEN bytes_transferred > 0 THEN format('Data Volume: {:,} bytes', bytes_transferred) END"])} AS evidence_chain
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, event_id) AS step_number FROM log) q"""
VIEWS["storied"] = """
SELECT entity_id, count(*) AS total_stages, CASE max(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS highest_severity,
  count(*) FILTER (WHERE severity <> 'INFO') AS anomalous_stages,
  strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS t0, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS t1
FROM staged GROUP BY entity_id"""
NARRATIVE = """CASE WHEN total_stages = 1 THEN format('Single event recorded for {} at {}.', entity_id, t0)
  WHEN anomalous_stages > 0 THEN format('Incident storyline initiated at {} with initial entry. Progressed through {} chronological stages, escalating to a {} incident at {}. {} anomalous stages identified in the chain.', t0, total_stages, highest_severity, t1, anomalous_stages)
  ELSE format('Normal user activity trace across {} events between {} and {}.', total_stages, t0, t1) END"""


def _stages(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return storyline.stages(log, find_hot_keys(log, "entity_id"))


@query("l1_storyline_stages", "SELECT * FROM staged")
def l1(spark, sf_dir):
    return _stages(spark, sf_dir).drop("color").withColumn("evidence_chain", F.array_join("evidence_chain", " | "))


@query("l2_storyline_summary", f"SELECT entity_id, total_stages, highest_severity, anomalous_stages, {NARRATIVE} AS attack_narrative FROM storied")
def l2(spark, sf_dir):
    return storyline.summaries(source.access_log(spark, sf_dir))


@query("l3_milestones", """
SELECT entity_id, event_id, step_number,
  CASE WHEN a > 0 THEN attack_vector <> 'Normal' ELSE step_number <= 10 END AS is_milestone,
  step_number > CASE WHEN a > 0 THEN a ELSE least(10, n) END AS is_remainder
FROM (SELECT *, count(*) FILTER (WHERE attack_vector <> 'Normal') OVER (PARTITION BY entity_id) AS a,
  count(*) OVER (PARTITION BY entity_id) AS n FROM staged) q""")
def l3(spark, sf_dir):
    return storyline.milestones(_stages(spark, sf_dir)).select(
        "entity_id", "event_id", "step_number", "is_milestone", "is_remainder"
    )
