"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import baseline, clean, reports, triage
from ...sources import access_log as source
from .registry import VIEWS, haversine, pretty, query, rounded, train_of

VIEWS["anomalous"] = "SELECT * FROM log WHERE label = 'anomaly'"
_COUNT = "count(*) FILTER (WHERE label = 'anomaly'{})"


def _log(spark, sf_dir):
    return source.access_log(spark, sf_dir)


@query("a1_kpi", f"""
SELECT count(*) AS total_events, count(*) - {_COUNT.format("")} AS normal_events,
  round((count(*) - {_COUNT.format("")}) / count(*) * 100, 6) AS normal_pct, {_COUNT.format("")} AS active_threats,
  {_COUNT.format(" AND attack_type IN ('brute_force', 'impossible_travel', 'credential_stuffing')")} AS high_alerts,
  {_COUNT.format(" AND attack_type IN ('lateral_movement', 'low_slow_exfiltration')")} AS critical_incidents
FROM log""")
def a1(spark, sf_dir):
    return rounded(reports.kpi(_log(spark, sf_dir)), "normal_pct")


@query("a2_by_attack_type", f"SELECT {pretty('attack_type')} AS attack, count(*) AS incidents FROM anomalous GROUP BY attack_type ORDER BY 2 DESC, 1")
def a2(spark, sf_dir):
    return reports.by_attack_type(_log(spark, sf_dir))


@query("a3_by_department", "SELECT department, count(*) AS incidents FROM anomalous GROUP BY 1 ORDER BY 2 DESC, 1")
def a3(spark, sf_dir):
    return reports.by_department(_log(spark, sf_dir))


@query("a4_hourly_trend", "SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS hour, count(*) AS incidents FROM anomalous GROUP BY 1 ORDER BY 1")
def a4(spark, sf_dir):
    return reports.hourly_trend(_log(spark, sf_dir))


@query("a5_four_hour_buckets", "SELECT CAST(hr // 4 * 4 AS BIGINT) AS start_hour, count(*) AS incidents FROM anomalous GROUP BY 1 ORDER BY 1")
def a5(spark, sf_dir):
    return reports.four_hour_buckets(_log(spark, sf_dir))


@query("a6_dataset_summary", """
SELECT label, attack_type, count(*) AS events, round(count(*) / (SELECT count(*) FROM log) * 100, 6) AS pct_of_total,
  (SELECT count(*) FROM log) AS total_events, (SELECT count(*) FROM anomalous) AS anomaly_events,
  round((SELECT count(*) FROM anomalous) / (SELECT count(*) FROM log) * 100, 6) AS anomaly_pct,
  (SELECT min(timestamp) FROM log) AS first_time, (SELECT max(timestamp) FROM log) AS last_time
FROM log GROUP BY label, attack_type""")
def a6(spark, sf_dir):
    return rounded(reports.dataset_summary(_log(spark, sf_dir)), "pct_of_total", "anomaly_pct")


@query("a7_population", """
SELECT entity_type, entity_role, count(DISTINCT entity_id) AS entities,
  count(DISTINCT CASE WHEN coalesce(event_count, 0) < 10 THEN entity_id END) AS cold_start_entities
FROM log LEFT JOIN base USING (entity_id) GROUP BY 1, 2""")
def a7(spark, sf_dir):
    log = _log(spark, sf_dir)
    return reports.population(log, baseline.numeric_baselines(train_of(log)))


@query("a8_filter_values", """
SELECT DISTINCT 'attack_type' AS field, attack_type AS value FROM anomalous
UNION SELECT DISTINCT 'department', department FROM anomalous
UNION SELECT DISTINCT 'entity_id', entity_id FROM anomalous""")
def a8(spark, sf_dir):
    return reports.filter_values(_log(spark, sf_dir))


@query("a9_search_incidents", """
SELECT event_id, timestamp, entity_id, attack_type AS threat_category, source_ip, geo_location AS location,
  resource_accessed AS resource_targeted
FROM anomalous WHERE department = 'Operations' AND regexp_matches(entity_id, 'usr-00[0-3]', 'i')""")
def a9(spark, sf_dir):
    return reports.search_incidents(_log(spark, sf_dir), department="Operations", entity="usr-00[0-3]")


VIEWS["latest_state"] = """
SELECT incident_id AS event_id, arg_max(new_status, timestamp) AS status FROM audit GROUP BY 1"""
VIEWS["stateful"] = """
SELECT l.*, coalesce(s.status, CASE WHEN label = 'anomaly' THEN 'LIVE_THREAT' ELSE 'BENIGN' END) AS status
FROM log l LEFT JOIN latest_state s USING (event_id)"""


@query("a10_latest_events", f"""
SELECT event_id, CASE WHEN status = 'FALSE_POSITIVE' THEN 'FALSE POSITIVE' WHEN status = 'RESOLVED' THEN 'RESOLVED'
    WHEN status = 'UNDER_INVESTIGATION' THEN 'INVESTIGATING' WHEN label = 'anomaly' THEN 'ANOMALY' ELSE 'NORMAL' END AS badge,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS time, entity_id, department, source_ip, geo_location, resource_accessed,
  action_type, {pretty('attack_type')} AS threat_category
FROM stateful ORDER BY timestamp DESC, event_id DESC LIMIT 20""")
def a10(spark, sf_dir):
    log = _log(spark, sf_dir)
    # Twenty rows first; then their latest status. Labels stay as they were logged.
    latest = log.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(20)
    status = triage.latest_actions(source.audit(log)).select(
        F.col("incident_id").alias("event_id"), "status")
    initial = F.when(F.col("label") == "anomaly", "LIVE_THREAT").otherwise("BENIGN")
    state = latest.join(status, "event_id", "left").withColumn("status", F.coalesce("status", initial))
    return reports.latest_events(state)


@query("a11_entity_timeline", """
SELECT event_id, timestamp, action_type, resource_accessed, source_ip, geo_location, label, attack_type,
  CASE WHEN label = 'anomaly' THEN 'LIVE_THREAT' ELSE 'BENIGN' END AS status,
  CAST(CASE WHEN label = 'anomaly' THEN 12 ELSE 7 END AS BIGINT) AS marker_size
FROM log WHERE entity_id = 'USR-0007' ORDER BY timestamp, event_id""")
def a11(spark, sf_dir):
    return reports.entity_timeline(clean.with_triage_columns(_log(spark, sf_dir)), "USR-0007")


@query("a12_geo_points", """
SELECT event_id, entity_id, geo_location, geo_lat, geo_lon, label, attack_type, source_ip,
  CAST(CASE WHEN label = 'anomaly' THEN 12 ELSE 4 END AS BIGINT) AS marker_size
FROM log WHERE geo_lat IS NOT NULL AND geo_lon IS NOT NULL""")
def a12(spark, sf_dir):
    return reports.geo_points(_log(spark, sf_dir))


@query("a13_recent_audit", "SELECT * FROM audit ORDER BY timestamp DESC, incident_id DESC LIMIT 10")
def a13(spark, sf_dir):
    return reports.recent_audit(source.audit(_log(spark, sf_dir)))


@query("a14_active_incidents", "SELECT event_id, timestamp FROM anomalous ORDER BY timestamp, event_id LIMIT 50")
def a14(spark, sf_dir):
    return reports.active_incidents(_log(spark, sf_dir))


_PLACES = "SELECT DISTINCT geo_location AS far_place, geo_lat AS lat, geo_lon AS lon FROM log"


@query("j1_far_places", f"""
SELECT geo_location, far_place, round({haversine("s.geo_lat", "s.geo_lon", "p.lat", "p.lon")}, 6) AS distance_km, events
FROM (SELECT geo_location, geo_lat, geo_lon, count(*) AS events FROM log GROUP BY 1, 2, 3) s, ({_PLACES}) p
WHERE {haversine("s.geo_lat", "s.geo_lon", "p.lat", "p.lon")} > 2000""")
def j1(spark, sf_dir):
    return rounded(reports.far_places(_log(spark, sf_dir)), "distance_km")
