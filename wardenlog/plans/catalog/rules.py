"""Rule detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timeline import find_hot_keys
from ...operators import baseline, features, rules
from ...sources import access_log as source
from .registry import frame, log_of, query, rounded, train_of


@query("r1_brute_force", f"""
SELECT * FROM (SELECT event_id, timestamp, entity_id, source_ip, CAST(sum(CASE WHEN auth_method = 'password' THEN failed ELSE 0 END)
  OVER {frame(300_000_000, True, "entity_id, source_ip")} AS BIGINT) AS password_failures FROM log) q WHERE password_failures >= 10""")
def r1(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return rules.brute_force(log, hot=find_hot_keys(log, ["entity_id", "source_ip"]))


@query("r2_impossible_travel", """
SELECT event_id, entity_id, geo_location, minutes_since_last, round(geo_distance_km, 6) AS geo_distance_km,
  round(geo_velocity_kmh, 6) AS geo_velocity_kmh
FROM traveled WHERE minutes_since_last >= 0 AND minutes_since_last < 120 AND geo_velocity_kmh > 500""")
def r2(spark, sf_dir):
    log = source.access_log(spark, sf_dir).select("event_id", "timestamp", "entity_id", "geo_location", "geo_lat", "geo_lon")
    found = rules.impossible_travel(features.travel(log, find_hot_keys(log, "entity_id")))
    return rounded(found, "geo_distance_km", "geo_velocity_kmh")


@query("r3_credential_stuffing", f"""
SELECT event_id, timestamp, source_ip, entities_1h, failures_1h, events_1h FROM (
  SELECT *, count(DISTINCT entity_id) OVER {frame(3_600_000_000, True, "source_ip")} AS entities_1h,
    CAST(sum(failed) OVER {frame(3_600_000_000, True, "source_ip")} AS BIGINT) AS failures_1h,
    count(*) OVER {frame(3_600_000_000, True, "source_ip")} AS events_1h FROM log) q
WHERE entities_1h >= 6 AND failures_1h / events_1h >= 0.85""")
def r3(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return rules.credential_stuffing(log, hot=find_hot_keys(log, "source_ip"))


def _novel(spark, sf_dir):
    log = log_of(spark, sf_dir)
    train = train_of(log)
    return features.commands(features.novelty(log, baseline.known_values(train))), train


@query("r4_lateral_movement", """
SELECT entity_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS novel_accesses, count(DISTINCT resource_category) AS categories,
  CAST(sum(suspicious_cmd_flag) AS BIGINT) AS suspicious_sessions
FROM featured WHERE resource_novelty = 1 AND category_novelty = 1 GROUP BY 1, 2""")
def r4(spark, sf_dir):
    return rules.lateral_movement(_novel(spark, sf_dir)[0]).withColumn("day", F.col("day").cast("string"))


_FAMILY = """CASE WHEN starts_with(device_os, 'Windows') THEN 'windows' WHEN starts_with(device_os, 'macOS') THEN 'macos'
  WHEN starts_with(device_os, 'Android') OR starts_with(device_os, 'iOS') THEN 'mobile' WHEN device_os IN ('unknown', '') THEN 'unknown' ELSE 'linux' END"""


@query("r5_device_spoofing", f"""
SELECT event_id, entity_id, device_fingerprint, device_os, os_family FROM (SELECT *, {_FAMILY} AS os_family FROM novel) n
WHERE device_novelty = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT entity_id, {_FAMILY} AS f FROM train) t WHERE t.entity_id = n.entity_id AND t.f = n.os_family)""")
def r5(spark, sf_dir):
    return rules.device_spoofing(*_novel(spark, sf_dir))


@query("r6_low_and_slow", """
SELECT entity_id, count(*) AS days, CAST(sum(bytes) AS BIGINT) AS total_bytes, round(regr_slope(bytes, day - DATE '1970-01-01'), 3) AS bytes_per_day_slope
FROM (SELECT entity_id, CAST(timestamp AS DATE) AS day, sum(bytes_transferred) AS bytes FROM log
  WHERE (hr >= 22 OR hr <= 5) AND action_type IN ('read', 'download') AND resource_category IN ('finance_data', 'hr_data', 'infra_config')
  GROUP BY 1, 2) d
GROUP BY 1 HAVING count(*) >= 5 AND regr_slope(bytes, day - DATE '1970-01-01') > 0""")
def r6_(spark, sf_dir):
    found = rules.low_and_slow(source.access_log(spark, sf_dir))
    return found.withColumn("bytes_per_day_slope", F.round("bytes_per_day_slope", 3))


@query("r7_insider_drift", """
SELECT entity_id, CAST(min(week) AS VARCHAR) AS from_week, count(*) AS weeks, CAST(sum(new_resources) AS BIGINT) AS new_resources FROM (
  SELECT *, (week - DATE '1970-01-01') // 7 - row_number() OVER (PARTITION BY entity_id ORDER BY week) AS island FROM (
    SELECT entity_id, week, count(*) AS new_resources, min(week) OVER (PARTITION BY entity_id) AS start_week FROM (
      SELECT entity_id, resource_accessed, CAST(min(date_trunc('week', timestamp)) AS DATE) AS week FROM log GROUP BY 1, 2) f
    GROUP BY 1, 2) g WHERE week > start_week) h
GROUP BY entity_id, island HAVING count(*) >= 2""")
def r7(spark, sf_dir):
    found = rules.insider_drift(source.access_log(spark, sf_dir))
    return found.withColumn("from_week", F.col("from_week").cast("string"))
