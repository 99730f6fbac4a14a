"""SQL text of the fixture views (see FIXTURES.md); runs unchanged on Spark and on DuckDB."""

ACCESS_LOG = """
WITH a AS (
  SELECT event_id AS n, user_id, value, day(ts) > 21 AS late,
    n500 < 15 AS bf, n500 BETWEEN 100 AND 119 AS cs,
    CASE WHEN n500 < 15 OR (n500 BETWEEN 100 AND 119 AND n500 <> 119) THEN 'error' ELSE event_type END AS event_type,
    CASE WHEN n500 < 15 OR n500 BETWEEN 100 AND 119
      THEN ts - INTERVAL '1' SECOND * (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) + INTERVAL '7' SECOND * n500
      ELSE ts END AS ts
  FROM (SELECT *, CAST(event_id % 500 AS INT) AS n500 FROM events) e),
b AS (SELECT *, CASE WHEN bf THEN CAST((n - n % 500) / 500 AS BIGINT) % 40 WHEN late AND n % 47 = 0 THEN 50 + n % 3 ELSE user_id % 50 END AS u FROM a),
k AS (SELECT *,
  CASE WHEN late AND n % 31 = 0 THEN (u + 9) % 16 WHEN n % 13 = 0 THEN (u + 5) % 16 ELSE u % 16 END AS gi,
  CASE WHEN late AND n % 19 = 0 THEN (u + 5) % 7 WHEN n % 11 = 0 THEN (u + 3) % 7 ELSE u % 7 END AS ci,
  CASE WHEN u < 40 THEN u % 5 WHEN u < 46 THEN 5 ELSE 6 END AS ri FROM b)
SELECT
  'evt-' || lpad(CAST(n AS STRING), 8, '0') AS event_id,
  ts AS timestamp,
  'USR-' || lpad(CAST(u AS STRING), 4, '0') AS entity_id,
  CASE WHEN u < 40 THEN 'user' WHEN u < 46 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
  CASE ri WHEN 0 THEN 'employee' WHEN 1 THEN 'developer' WHEN 2 THEN 'hr' WHEN 3 THEN 'finance' WHEN 4 THEN 'admin' WHEN 5 THEN 'service' ELSE 'device' END AS entity_role,
  CASE ri WHEN 0 THEN 'Operations' WHEN 1 THEN 'Engineering' WHEN 2 THEN 'Human Resources' WHEN 3 THEN 'Finance' WHEN 4 THEN 'IT Infrastructure' WHEN 5 THEN 'Automated Services' ELSE 'IoT Operations' END AS department,
  CASE WHEN bf THEN '10.9.9.9' WHEN cs THEN '10.8.8.8' ELSE '10.0.' || CAST(n % 4 AS STRING) || '.' || CAST((n * 7) % 10 AS STRING) END AS source_ip,
  CASE gi WHEN 0 THEN 'Mumbai, IN' WHEN 1 THEN 'Delhi, IN' WHEN 2 THEN 'Bangalore, IN' WHEN 3 THEN 'Hyderabad, IN' WHEN 4 THEN 'Chennai, IN' WHEN 5 THEN 'Pune, IN' WHEN 6 THEN 'Kolkata, IN' WHEN 7 THEN 'Ahmedabad, IN' WHEN 8 THEN 'London, GB' WHEN 9 THEN 'New York, US' WHEN 10 THEN 'Singapore, SG' WHEN 11 THEN 'Dubai, AE' WHEN 12 THEN 'Tokyo, JP' WHEN 13 THEN 'San Francisco, US' WHEN 14 THEN 'Frankfurt, DE' ELSE 'Sydney, AU' END AS geo_location,
  CAST(CASE gi WHEN 0 THEN 19.0760 WHEN 1 THEN 28.6139 WHEN 2 THEN 12.9716 WHEN 3 THEN 17.3850 WHEN 4 THEN 13.0827 WHEN 5 THEN 18.5204 WHEN 6 THEN 22.5726 WHEN 7 THEN 23.0225 WHEN 8 THEN 51.5074 WHEN 9 THEN 40.7128 WHEN 10 THEN 1.3521 WHEN 11 THEN 25.2048 WHEN 12 THEN 35.6762 WHEN 13 THEN 37.7749 WHEN 14 THEN 50.1109 ELSE -33.8688 END AS DOUBLE) AS geo_lat,
  CAST(CASE gi WHEN 0 THEN 72.8777 WHEN 1 THEN 77.2090 WHEN 2 THEN 77.5946 WHEN 3 THEN 78.4867 WHEN 4 THEN 80.2707 WHEN 5 THEN 73.8567 WHEN 6 THEN 88.3639 WHEN 7 THEN 72.5714 WHEN 8 THEN -0.1278 WHEN 9 THEN -74.0060 WHEN 10 THEN 103.8198 WHEN 11 THEN 55.2708 WHEN 12 THEN 139.6503 WHEN 13 THEN -122.4194 WHEN 14 THEN 8.6821 ELSE 151.2093 END AS DOUBLE) AS geo_lon,
  '/r' || CAST(ci AS STRING) || '/' || CASE WHEN n % 17 = 0 THEN 'x' || CAST(n % 101 AS STRING) ELSE CAST((n * 3) % 6 AS STRING) END AS resource_accessed,
  CASE ci WHEN 0 THEN 'code_repo' WHEN 1 THEN 'email' WHEN 2 THEN 'hr_data' WHEN 3 THEN 'finance_data' WHEN 4 THEN 'admin_panel' WHEN 5 THEN 'infra_config' ELSE 'general' END AS resource_category,
  CASE event_type WHEN 'error' THEN 'login' WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'download' ELSE 'read' END AS action_type,
  CASE WHEN bf OR cs OR n % 20 = 0 THEN 'password' ELSE CASE u % 4 WHEN 0 THEN 'sso' WHEN 1 THEN 'token' WHEN 2 THEN 'certificate' ELSE 'biometric' END END AS auth_method,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS auth_status,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 60) AS BIGINT) END AS session_duration,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 1000) AS BIGINT) END AS bytes_transferred,
  CASE WHEN late AND n % 43 = 0 THEN 'fp-late' || CAST(u AS STRING) WHEN n % 29 = 0 THEN 'fp-new' || CAST(n % 37 AS STRING) ELSE 'fp-' || CAST(u * 2 + n % 2 AS STRING) END AS device_fingerprint,
  CASE WHEN late AND n % 43 = 0 THEN 'iOS 17' WHEN n % 29 = 0 THEN 'Ubuntu 22.04' WHEN u % 3 = 0 THEN 'Windows 11' ELSE 'macOS 14' END AS device_os,
  'Mozilla/5.0' AS user_agent,
  CASE WHEN late AND n % 41 = 0 THEN 'RDP' WHEN n % 23 = 0 THEN 'SSH' ELSE 'HTTPS' END AS protocol,
  CASE n % 10 WHEN 0 THEN '["whoami", "id"]' WHEN 1 THEN '["docker ps", "docker logs app-server"]' WHEN 2 THEN '["df -h", "df -h"]' ELSE '[]' END AS command_sequence,
  (n % 9 = 0) AS is_vpn,
  CASE WHEN n % 25 = 0 THEN 'anomaly' ELSE 'normal' END AS label,
  CASE n % 175 WHEN 0 THEN 'brute_force' WHEN 25 THEN 'impossible_travel' WHEN 50 THEN 'credential_stuffing' WHEN 75 THEN 'lateral_movement' WHEN 100 THEN 'device_spoofing' WHEN 125 THEN 'low_slow_exfiltration' WHEN 150 THEN 'insider_drift' ELSE 'normal' END AS attack_type,
  CASE n % 175 WHEN 0 THEN 'dictionary_attack' WHEN 25 THEN 'geo_velocity_violation' WHEN 50 THEN 'automated_credential_test' WHEN 75 THEN 'cross_category_scanning' WHEN 100 THEN 'os_family_mismatch' WHEN 125 THEN 'off_hours_data_transfer' WHEN 150 THEN 'gradual_scope_expansion' ELSE 'normal' END AS attack_subtype
FROM k
"""

SCORED = """
SELECT event_id, label, attack_type,
  CAST((n * 37) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.7 AS DOUBLE)
    + CASE WHEN n % 25 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS anomaly_score,
  CAST(0.5 AS DOUBLE) + CAST((n * 53) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE) AS classifier_confidence,
  CASE WHEN n % 4 = 0 THEN 'insider_drift' ELSE attack_type END AS predicted_attack
FROM (SELECT *, CAST(substring(event_id, 5) AS BIGINT) AS n FROM access_log) q
"""

AUDIT = """
WITH q AS (SELECT event_id, timestamp, CAST(substring(event_id, 5) AS BIGINT) AS n FROM access_log WHERE label = 'anomaly'),
a AS (
  SELECT timestamp + INTERVAL '1' HOUR AS timestamp, event_id, n, 'UNDER_INVESTIGATION' AS new_status FROM q WHERE n % 50 = 0
  UNION ALL
  SELECT timestamp + INTERVAL '2' HOUR, event_id, n, CASE WHEN n % 200 = 0 THEN 'FALSE_POSITIVE' ELSE 'RESOLVED' END FROM q WHERE n % 100 = 0
  UNION ALL
  SELECT timestamp + INTERVAL '3' HOUR, event_id, n, 'CONFIRMED_THREAT' FROM q WHERE n % 400 = 0)
SELECT timestamp, event_id AS incident_id,
  COALESCE(LAG(new_status) OVER (PARTITION BY event_id ORDER BY timestamp), 'LIVE_THREAT') AS previous_status,
  new_status, 'analyst-' || CAST(n % 3 AS STRING) AS analyst,
  CASE WHEN n % 3 = 0 THEN '' ELSE 'note ' || CAST(n % 7 AS STRING) || ' ' || lower(new_status) END AS remarks
FROM a
"""
