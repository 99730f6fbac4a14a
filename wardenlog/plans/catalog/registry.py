"""Registry of the named queries, and the shared views of their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ... import fixed_values as V
from ...operators import baseline, clean
from ...session import apply_settings
from ...sources import _access_log_sql as fixture
from ...sources import access_log as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to the shared views."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix a statement with the views it needs, each after those it refers to."""
    ordered: dict[str, str] = {}

    def need(text: str) -> None:
        for v in re.findall(r"[a-z_][a-z_0-9]*", text):
            if v in VIEWS and v not in ordered and VIEWS[v] is not text:
                need(VIEWS[v])
                ordered[v] = VIEWS[v]

    need(sql)
    parts = [f"{v} AS ({body})" for v, body in ordered.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


# --- Frames -----------------------------------------------------------------------------------------


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, labelled log."""
    return source.access_log(spark, sf_dir).transform(clean.parse_commands)


def train_of(log: DataFrame) -> DataFrame:
    return log.where(clean.find_cut(log).is_train())


def dirty_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text with defects and repeated events."""
    log = source.access_log(spark, sf_dir)
    return spark.sql(DIRTY.replace("FROM access_log", "FROM {access_log}"), access_log=log)


def r6(c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def joined(c: str) -> Column:
    return F.array_join(c, " | ").alias(c)


# --- Views ------------------------------------------------------------------------------------------

# Defects: unreadable and differently written times, missing and unreadable values, values out of range,
# unknown categories, malformed lists, line breaks within fields, and a tenth of the events twice.
DIRTY = """
SELECT event_id, ts AS timestamp, entity_id, entity_type, entity_role,
  CASE WHEN n % 89 = 0 THEN NULL ELSE department END AS department, source_ip, geo_location,
  CASE WHEN n % 73 = 0 THEN '95.0' WHEN n % 71 = 0 THEN 'north' ELSE CAST(geo_lat AS STRING) END AS geo_lat,
  CAST(geo_lon AS STRING) AS geo_lon, resource_accessed, resource_category, action_type, auth_method, auth_status,
  CASE WHEN n % 83 = 0 THEN 'x' ELSE CAST(session_duration AS STRING) END AS session_duration,
  CASE WHEN n % 79 = 0 THEN '-5' ELSE CAST(bytes_transferred AS STRING) END AS bytes_transferred,
  device_fingerprint, device_os, CASE WHEN copy = 1 THEN 'copy' WHEN n % 47 = 0 THEN 'two' || chr(10) || 'lines, "quoted"' ELSE user_agent END AS user_agent,
  CASE WHEN n % 61 = 0 THEN 'FTP' ELSE protocol END AS protocol,
  CASE WHEN n % 67 = 0 THEN '[''net user'', ''ls'']' WHEN n % 53 = 0 THEN '["ls", ' WHEN n % 51 = 0 THEN NULL
    ELSE command_sequence END AS command_sequence,
  CASE WHEN n % 7 = 0 THEN NULL WHEN is_vpn THEN 'True' ELSE 'False' END AS is_vpn,
  CASE WHEN n % 57 = 0 THEN NULL ELSE label END AS label,
  CASE WHEN n % 59 = 0 THEN 'mystery' ELSE attack_type END AS attack_type, attack_subtype
FROM (
  SELECT *, CASE WHEN n % 97 = 0 THEN 'not a time'
    WHEN n % 3 = 0 THEN replace(CAST(timestamp AS STRING), ' ', 'T') || 'Z' ELSE CAST(timestamp AS STRING) END AS ts
  FROM (
    SELECT *, CAST(substring(event_id, 5) AS BIGINT) AS n, 0 AS copy FROM access_log
    UNION ALL
    SELECT *, CAST(substring(event_id, 5) AS BIGINT) AS n, 1 AS copy FROM access_log
    WHERE CAST(substring(event_id, 5) AS BIGINT) % 10 = 0
  ) q
) d
"""

VIEWS["access_log"] = fixture.ACCESS_LOG
VIEWS["scored"] = fixture.SCORED
VIEWS["audit"] = fixture.AUDIT
VIEWS["dirty"] = DIRTY
VIEWS["log"] = """
SELECT *, epoch_us(timestamp) AS us, CAST(hour(timestamp) AS BIGINT) AS hr,
  CASE WHEN auth_status = 'failure' THEN 1 ELSE 0 END AS failed,
  CASE WHEN hour(timestamp) < 8 OR hour(timestamp) > 19 THEN 1 ELSE 0 END AS off_hours,
  CASE WHEN command_sequence = '[]' THEN CAST([] AS VARCHAR[]) ELSE CAST(from_json(command_sequence, '["VARCHAR"]') AS VARCHAR[]) END AS command_list
FROM access_log"""
VIEWS["train"] = """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS rn, count(*) OVER () AS n_all FROM log) q
WHERE rn <= CAST(floor(n_all * 0.6) AS BIGINT)"""
VIEWS["auth_mode"] = """
SELECT entity_id, auth_method AS primary_auth_method FROM (
  SELECT entity_id, auth_method, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, auth_method) AS k
  FROM train GROUP BY entity_id, auth_method) q WHERE k = 1"""


def _std(expr: str, single: float) -> str:
    return (f"CASE WHEN count(*) = 1 THEN {single} WHEN coalesce(stddev_samp({expr}), 0) = 0 THEN 1.0 "
            f"ELSE stddev_samp({expr}) END")


VIEWS["base"] = f"""
SELECT entity_id, count(*) AS event_count,
  avg(hr) AS mean_hour, {_std("hr", 4.0)} AS std_hour,
  avg(session_duration) AS mean_session_duration, {_std("session_duration", 600.0)} AS std_session_duration,
  avg(bytes_transferred) AS mean_bytes, {_std("bytes_transferred", 10000.0)} AS std_bytes
FROM train GROUP BY entity_id"""
KINDS = baseline.KNOWN_KINDS
VIEWS["known"] = " UNION ".join(
    f"SELECT entity_id, '{k}' AS kind, {c} AS value FROM train" for k, c in KINDS.items()
)
VIEWS["novel"] = "SELECT l.*, " + ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.entity_id = l.entity_id AND k.kind = '{k}' "
    f"AND k.value = l.{c}) THEN 0 ELSE 1 END AS {k}_novelty" for k, c in KINDS.items()
) + " FROM log l"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(6371.0 * 2 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


VIEWS["lagged"] = """
SELECT *, lag(us) OVER w AS prev_us, lag(geo_lat) OVER w AS prev_lat, lag(geo_lon) OVER w AS prev_lon
FROM novel WINDOW w AS (PARTITION BY entity_id ORDER BY us, event_id)"""
VIEWS["moved"] = f"""
SELECT *, coalesce((us - prev_us) / 60e6, -1.0) AS minutes_since_last,
  coalesce({haversine("prev_lat", "prev_lon", "geo_lat", "geo_lon")}, 0.0) AS geo_distance_km FROM lagged"""
VIEWS["traveled"] = """
SELECT *, CASE WHEN prev_us IS NULL OR us = prev_us THEN 0.0
  ELSE least(geo_distance_km / (minutes_since_last / 60), 50000.0) END AS geo_velocity_kmh FROM moved"""


def _z(expr: str, name: str) -> str:
    return f"coalesce(greatest(-10.0, least(10.0, ({expr} - mean_{name}) / std_{name})), 0.0)"


SUSPICIOUS = "(" + " OR ".join(f"contains(lower(array_to_string(command_list, ' ')), '{k}')" for k in V.SUSPICIOUS_KEYWORDS) + ")"
VIEWS["featured"] = f"""
SELECT t.*, {_z("hr", "hour")} AS hour_zscore,
  {_z("session_duration", "session_duration")} AS session_duration_zscore,
  {_z("bytes_transferred", "bytes")} AS bytes_zscore,
  CASE WHEN {SUSPICIOUS} THEN 1 ELSE 0 END AS suspicious_cmd_flag,
  CASE WHEN len(command_list) = 0 THEN 0.0 ELSE len(list_distinct(command_list)) / len(command_list) END AS command_diversity,
  CASE resource_category WHEN 'general' THEN 0.1 WHEN 'email' THEN 0.2 WHEN 'code_repo' THEN 0.4 WHEN 'hr_data' THEN 0.7
    WHEN 'finance_data' THEN 0.8 WHEN 'admin_panel' THEN 0.9 WHEN 'infra_config' THEN 1.0 ELSE 0.3 END AS resource_sensitivity,
  failed AS auth_failure_flag,
  geo_novelty + device_novelty + resource_novelty + category_novelty + protocol_novelty + off_hours AS risk_multiplier,
  CASE WHEN session_duration = 0 THEN 0.0 ELSE least(bytes_transferred / session_duration, 1000000.0) END AS bytes_per_second,
  CASE WHEN auth_method <> primary_auth_method THEN 1 ELSE 0 END AS auth_method_change,
  CASE WHEN coalesce(event_count, 0) < 10 THEN 1 ELSE 0 END AS is_cold_start
FROM traveled t LEFT JOIN base USING (entity_id) LEFT JOIN auth_mode USING (entity_id)"""

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


def frame(length: int, inclusive: bool = False, key: str = "entity_id") -> str:
    end = "CURRENT ROW" if inclusive else "1 PRECEDING"
    return f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN {length} PRECEDING AND {end})"


VIEWS["windowed"] = f"""
SELECT *,
  coalesce(sum(failed) OVER {frame(HOUR_US)}, 0) AS failed_auth_count_1h,
  count(*) OVER {frame(HOUR_US)} AS total_events_1h,
  coalesce(sum(failed) OVER {frame(DAY_US)}, 0) AS failed_auth_count_24h,
  coalesce(sum(bytes_transferred) OVER {frame(DAY_US)}, 0) AS bytes_total_24h,
  coalesce(sum(off_hours) OVER {frame(7 * DAY_US)}, 0) AS off_hours_event_count_7d,
  count(DISTINCT resource_accessed) OVER {frame(HOUR_US, True)} AS unique_resources_1h,
  count(DISTINCT resource_accessed) OVER {frame(DAY_US, True)} AS unique_resources_24h,
  count(DISTINCT geo_location) OVER {frame(DAY_US, True)} AS unique_geos_24h,
  count(DISTINCT entity_id) OVER {frame(HOUR_US, True, "source_ip")} AS unique_entities_per_ip_1h,
  sum(CASE WHEN label = 'anomaly' THEN 1 ELSE 0 END) OVER {frame(DAY_US, True)} AS repeat_anomalies_24h
FROM featured"""


def pretty(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, '_'), "
            f"lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")


def joined_sql(items: list[str], sep: str = " | ") -> str:
    """Non-null items joined; mirrors compacted arrays."""
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL), '{sep}')"
