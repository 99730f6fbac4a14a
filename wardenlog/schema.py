"""Fixed schemas of the inputs. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING = T.StringType()

EVENT_COLUMNS = [
    "event_id", "timestamp", "entity_id", "entity_type", "entity_role", "department", "source_ip",
    "geo_location", "geo_lat", "geo_lon", "resource_accessed", "resource_category", "action_type",
    "auth_method", "auth_status", "session_duration", "bytes_transferred", "device_fingerprint",
    "device_os", "user_agent", "protocol", "command_sequence", "is_vpn",
]
LABEL_COLUMNS = ["label", "attack_type", "attack_subtype"]
META_COLUMNS = ["event_id", "timestamp", "entity_id", "source_ip", "resource_accessed"]
CATEGORICAL_COLUMNS = [
    "entity_type", "entity_role", "department", "resource_category",
    "action_type", "auth_method", "auth_status", "protocol",
]

_TYPED = {
    "timestamp": T.TimestampNTZType(),
    "geo_lat": T.DoubleType(),
    "geo_lon": T.DoubleType(),
    "session_duration": T.LongType(),
    "bytes_transferred": T.LongType(),
    "is_vpn": T.BooleanType(),
}

# A raw log is read as text so that a bad field becomes null in the typing step and is counted there,
# instead of the reader dropping or nulling the whole record.
RAW_EVENTS = T.StructType([T.StructField(c, _STRING) for c in EVENT_COLUMNS])
EVENTS = T.StructType([T.StructField(c, _TYPED.get(c, _STRING)) for c in EVENT_COLUMNS])
EVENT_LABELS = T.StructType([T.StructField(c, _STRING) for c in ["event_id", *LABEL_COLUMNS]])
LABELLED_EVENTS = T.StructType(EVENTS.fields + EVENT_LABELS.fields[1:])

RAW_PROFILES = T.StructType([
    T.StructField("entity_id", _STRING),
    T.StructField("entity_type", _STRING),
    T.StructField("entity_role", _STRING),
    T.StructField("department", _STRING),
    T.StructField("primary_geo", _STRING),
    T.StructField("secondary_geo", _STRING),
    T.StructField("work_hours_start", T.IntegerType()),
    T.StructField("work_hours_end", T.IntegerType()),
    T.StructField("work_days", _STRING),
    T.StructField("known_devices", _STRING),
    T.StructField("typical_resources", _STRING),
    T.StructField("typical_auth_method", _STRING),
    T.StructField("avg_session_duration", T.LongType()),
    T.StructField("avg_bytes_per_session", T.LongType()),
    T.StructField("onboarding_date", T.DateType()),
])

AUDIT = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("incident_id", _STRING),
    T.StructField("previous_status", _STRING),
    T.StructField("new_status", _STRING),
    T.StructField("analyst", _STRING),
    T.StructField("remarks", _STRING),
])
