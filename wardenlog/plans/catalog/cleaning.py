"""Cleaning, validation, encoding, splitting, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import fixed_values as V
from ...operators import clean, validate
from ...schema import CATEGORICAL_COLUMNS, EVENT_COLUMNS, LABEL_COLUMNS
from ...sources import access_log as source
from .registry import VIEWS, dirty_of, joined, joined_sql, log_of, query

_ALL = ", ".join(EVENT_COLUMNS)

VIEWS["firsts"] = f"""
SELECT {_ALL}, label, attack_type, attack_subtype FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, user_agent) AS k FROM dirty) q WHERE k = 1"""
VIEWS["typed"] = """
SELECT * REPLACE (
  CAST(try_cast(replace(replace(timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP) AS TIMESTAMP) AS timestamp,
  try_cast(session_duration AS BIGINT) AS session_duration,
  try_cast(bytes_transferred AS BIGINT) AS bytes_transferred,
  try_cast(geo_lat AS DOUBLE) AS geo_lat, try_cast(geo_lon AS DOUBLE) AS geo_lon,
  coalesce(lower(is_vpn) = 'true', false) AS is_vpn) FROM firsts"""
_UNKNOWN = ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in clean.UNKNOWN_FILLED)
_ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in clean.ZERO_FILLED)
_NORMAL = ", ".join(f"coalesce({c}, 'normal') AS {c}" for c in LABEL_COLUMNS)
VIEWS["filled"] = f"SELECT * REPLACE ({_UNKNOWN}, {_ZERO}, {_NORMAL}) FROM typed"
_VALID = ("timestamp IS NOT NULL AND geo_lat BETWEEN -90 AND 90 AND geo_lon BETWEEN -180 AND 180 "
          "AND session_duration >= 0 AND bytes_transferred >= 0")
VIEWS["valid"] = f"SELECT * FROM filled WHERE {_VALID}"
_LIST = """CASE WHEN starts_with(command_sequence, '[') AND ends_with(command_sequence, ']') AND command_sequence <> '[]'
  THEN CAST(from_json(replace(command_sequence, '''', '"'), '["VARCHAR"]') AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END"""


def _typed(spark, sf_dir):
    return clean.fix_types(clean.drop_duplicates_first(dirty_of(spark, sf_dir)))


@query("c1_attach_labels", """
SELECT e.event_id, e.entity_id, l.label, l.attack_type, l.attack_subtype
FROM access_log e LEFT JOIN (SELECT * FROM access_log WHERE label = 'anomaly') l USING (event_id)""")
def c1(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    labels = log.where(F.col("label") == "anomaly").select("event_id", *LABEL_COLUMNS)
    # Labels arrive twice; joining must not multiply events.
    twice = labels.unionByName(labels)
    return clean.attach_labels(log.select(*EVENT_COLUMNS), twice).select("event_id", "entity_id", *LABEL_COLUMNS)


@query("c2_first_of_duplicates", "SELECT event_id, timestamp, user_agent, department FROM firsts")
def c2(spark, sf_dir):
    return clean.drop_duplicates_first(dirty_of(spark, sf_dir)).select(
        "event_id", "timestamp", "user_agent", "department"
    )


@query("c3_fix_types", """
SELECT event_id, timestamp, CAST(session_duration AS DOUBLE) AS session_duration,
  CAST(bytes_transferred AS DOUBLE) AS bytes_transferred, geo_lat, geo_lon, is_vpn FROM typed""")
def c3(spark, sf_dir):
    # As doubles, since whole numbers with nulls have no common form across engines' result frames.
    return _typed(spark, sf_dir).select(
        "event_id", "timestamp", F.col("session_duration").cast("double").alias("session_duration"),
        F.col("bytes_transferred").cast("double").alias("bytes_transferred"), "geo_lat", "geo_lon", "is_vpn",
    )


@query("c4_fill_missing", f"SELECT event_id, {', '.join(clean.ZERO_FILLED + clean.UNKNOWN_FILLED + LABEL_COLUMNS)} FROM filled")
def c4(spark, sf_dir):
    return clean.fill_missing(_typed(spark, sf_dir)).select(
        "event_id", *clean.ZERO_FILLED, *clean.UNKNOWN_FILLED, *LABEL_COLUMNS
    )


@query("c5_drop_invalid", "SELECT event_id, timestamp, geo_lat, bytes_transferred FROM valid")
def c5(spark, sf_dir):
    return clean.drop_invalid(clean.fill_missing(_typed(spark, sf_dir))).select(
        "event_id", "timestamp", "geo_lat", "bytes_transferred"
    )


@query("c6_parse_commands", f"""
SELECT event_id, array_to_string({_LIST}, ' | ') AS command_list, CAST(len({_LIST}) AS BIGINT) AS command_count FROM filled""")
def c6(spark, sf_dir):
    return clean.parse_commands(clean.fill_missing(_typed(spark, sf_dir))).select(
        "event_id", joined("command_list"), "command_count"
    )


@query("c7_chronological", "SELECT event_id, timestamp, entity_id FROM valid ORDER BY timestamp, event_id")
def c7(spark, sf_dir):
    return clean.chronological(clean.clean(dirty_of(spark, sf_dir)).select("event_id", "timestamp", "entity_id"))


_FILLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in clean.ZERO_FILLED + clean.UNKNOWN_FILLED)


@query("c8_cleaning_statistics", f"""
SELECT (SELECT count(*) FROM dirty) AS rows_loaded,
  (SELECT count(*) - count(DISTINCT event_id) FROM dirty) AS duplicates_removed,
  (SELECT CAST(sum({_FILLS}) AS BIGINT) FROM typed) AS missing_filled,
  (SELECT count(*) FROM filled WHERE NOT coalesce({_VALID}, false)) AS invalid_removed,
  (SELECT count(*) FROM valid) AS final_rows""")
def c8(spark, sf_dir):
    return clean.cleaning_statistics(dirty_of(spark, sf_dir).drop(*LABEL_COLUMNS))


def _codes(c):
    return (f"coalesce((SELECT v.code FROM (SELECT {c} AS val, row_number() OVER (ORDER BY {c}) - 1 AS code "
            f"FROM (SELECT DISTINCT {c} FROM train) d) v WHERE v.val = l.{c}), -1) AS {c}_encoded, {c} AS {c}_raw")


@query("c9_encode_categories", f"SELECT event_id, {', '.join(_codes(c) for c in CATEGORICAL_COLUMNS)} FROM log l")
def c9(spark, sf_dir):
    log = log_of(spark, sf_dir)
    train = log.where(clean.find_cut(log).is_train())
    out = clean.encode_categories(log, clean.fit_categories(train))
    return out.select("event_id", *[f"{c}{s}" for c in CATEGORICAL_COLUMNS for s in ("_encoded", "_raw")])


@query("c10_temporal_split", """
SELECT l.event_id, l.timestamp, CASE WHEN t.event_id IS NULL THEN 'test' ELSE 'train' END AS part
FROM log l LEFT JOIN train t ON t.event_id = l.event_id""")
def c10(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    part = F.when(clean.find_cut(log).is_train(), "train").otherwise("test").alias("part")
    return log.select("event_id", "timestamp", part)


@query("c11_model_features", """
SELECT event_id, geo_lat, geo_lon, session_duration, bytes_transferred, CAST(len(command_list) AS BIGINT) AS command_count,
  hr AS hour_of_day, CAST(off_hours AS BIGINT) AS is_off_hours FROM log""")
def c11(spark, sf_dir):
    from ...operators import features

    log = features.calendar(log_of(spark, sf_dir)).drop("day_of_week", "is_weekend")
    names = clean.model_features(log)
    return log.select("event_id", *names).fillna(0)


@query("c12_align_features", """
SELECT event_id, 0.0::DOUBLE AS not_there, CAST(bytes_transferred AS DOUBLE) AS bytes_transferred, geo_lat FROM log""")
def c12(spark, sf_dir):
    log = log_of(spark, sf_dir).select("event_id", "geo_lat", "bytes_transferred", "geo_lon")
    return clean.align_features(log, ["not_there", "bytes_transferred", "geo_lat"], keep=["event_id"])


@query("c13_order_columns", """
SELECT event_id, timestamp, entity_id, source_ip, resource_accessed, protocol AS protocol_raw, bytes_transferred,
  label, attack_type, attack_subtype FROM log""")
def c13(spark, sf_dir):
    log = log_of(spark, sf_dir).withColumn("protocol_raw", F.col("protocol"))
    return clean.order_columns(log.select(
        *LABEL_COLUMNS, "bytes_transferred", "protocol_raw", "resource_accessed", "source_ip", "entity_id",
        "timestamp", "event_id",
    ))


_ENUMS = {
    "entity_type": V.ENTITY_TYPES, "entity_role": V.ENTITY_ROLES, "resource_category": V.RESOURCE_CATEGORIES,
    "auth_method": V.AUTH_METHODS, "auth_status": V.AUTH_STATUSES, "action_type": V.ACTION_TYPES, "protocol": V.PROTOCOLS,
}
_ATTACKS = V.ATTACK_TYPES


def _enum_error(c, allowed):
    values = ", ".join(f"'{v}'" for v in allowed)
    return f"CASE WHEN {c} NOT IN ({values}) THEN 'Invalid {c}: ' || {c} END"


_EVENT_ERRORS = [_enum_error(c, v) for c, v in _ENUMS.items()] + [
    f"CASE WHEN {c} < 0 THEN 'Negative {c}: ' || CAST({c} AS VARCHAR) END" for c in ("session_duration", "bytes_transferred")
] + [
    f"CASE WHEN {c} NOT BETWEEN -{b} AND {b} THEN 'Invalid {c}: ' || CAST({c} AS VARCHAR) END"
    for c, b in (("geo_lat", 90), ("geo_lon", 180))
]
_LABEL_ERRORS = [_enum_error("label", ["normal", "anomaly"]), _enum_error("attack_type", _ATTACKS)]
VIEWS["checked"] = f"SELECT event_id, {joined_sql(_EVENT_ERRORS + _LABEL_ERRORS)} AS errors FROM filled"


def _filled(spark, sf_dir):
    return clean.fill_missing(_typed(spark, sf_dir))


@query("c14_event_errors", f"SELECT event_id, {joined_sql(_EVENT_ERRORS)} AS errors FROM filled")
def c14(spark, sf_dir):
    return _filled(spark, sf_dir).select("event_id", F.array_join(validate.event_errors(), " | ").alias("errors"))


@query("c15_label_errors", f"SELECT event_id, {joined_sql(_LABEL_ERRORS)} AS errors FROM filled")
def c15(spark, sf_dir):
    return _filled(spark, sf_dir).select("event_id", F.array_join(validate.label_errors(), " | ").alias("errors"))


@query("c16_validation_summary", """
SELECT event_id, errors, (SELECT count(*) FROM checked WHERE errors <> '') AS bad_rows
FROM checked WHERE errors <> '' ORDER BY event_id LIMIT 10""")
def c16(spark, sf_dir):
    return validate.validation_summary(_filled(spark, sf_dir)).select("event_id", joined("errors"), "bad_rows")


@query("c17_triage_columns", """
SELECT event_id, CASE WHEN label = 'anomaly' THEN 'LIVE_THREAT' ELSE 'BENIGN' END AS status,
  '' AS analyst_feedback, '' AS last_updated, '' AS updated_by FROM log""")
def c17(spark, sf_dir):
    return clean.with_triage_columns(source.access_log(spark, sf_dir)).select(
        "event_id", "status", "analyst_feedback", "last_updated", "updated_by"
    )
