"""Behavioural identity: what is usual for an entity, and how far an event departs from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import compact, micros, thousands

CHECKS = {
    "off_hours_access": 20.0,
    "unusual_location": 25.0,
    "unrecognized_device": 15.0,
    "sensitive_resource_access": 20.0,
    "abnormal_data_volume": 20.0,
}
_SETS = {
    "typical_devices": "device_fingerprint",
    "typical_countries": "geo_location",
    "normal_resources": "resource_accessed",
    "normal_commands": "action_type",
}


def profile_statistics(history: DataFrame) -> DataFrame:
    """Scalar part of the profile. Hours have 24 values, so their exact percentile keeps at most 24 counts."""
    hour = F.hour("timestamp")
    days = F.greatest(F.lit(1), F.expr("(max(_us) - min(_us)) div 86400000000"))
    grouped = history.withColumn("_us", micros("timestamp")).groupBy("entity_id").agg(
        F.min(F.struct("timestamp", "event_id", "department"))["department"].alias("department"),
        F.percentile(hour, 0.1).cast("bigint").alias("hour_low"),
        F.percentile(hour, 0.9).cast("bigint").alias("hour_high"),
        (F.count(F.lit(1)) / days).alias("login_frequency"),
        F.avg("session_duration").alias("avg_session_duration"),
        F.avg("bytes_transferred").alias("avg_bytes_transferred"),
        F.count(F.lit(1)).alias("total_historical_events"),
    )
    return grouped


def typical_sets(history: DataFrame) -> DataFrame:
    """Sorted sets of the entity's values; combinations are made distinct in the map tasks first."""
    combos = history.select("entity_id", *_SETS.values()).distinct()
    return combos.groupBy("entity_id").agg(
        *[F.sort_array(F.collect_set(c)).alias(name) for name, c in _SETS.items()]
    )


def build_profiles(history: DataFrame) -> DataFrame:
    """One record per entity; averages are kept unrounded here and rounded in the payload."""
    return profile_statistics(history).join(typical_sets(history), "entity_id")


def profile_payload(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({
        "login_frequency": F.round("login_frequency", 1),
        "avg_session_duration": F.round("avg_session_duration", 1),
        "avg_bytes_transferred": F.round("avg_bytes_transferred", 1),
    })


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill the profile columns of entities without history."""
    defaults = {}
    for name, value in V.PROFILE_DEFAULTS.items():
        if name in df.columns:
            literal = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
            defaults[name] = F.coalesce(F.col(name), literal)
    return df.withColumns(defaults)


def lookup_profiles(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    return with_defaults(entities.join(profiles, "entity_id", "left"))


def typical_values(history: DataFrame) -> DataFrame:
    """Values seen per entity in long form, for the membership checks."""
    kinds = {"geo": "geo_location", "device": "device_fingerprint", "resource": "resource_accessed"}
    combos = history.select("entity_id", *kinds.values()).distinct()
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()
    ])).alias("_p")
    return combos.select("entity_id", pairs).select("entity_id", "_p.*").distinct()


def unusual_flags(df: DataFrame, typical: DataFrame) -> DataFrame:
    """``unusual_<kind>`` per distinct combination of entity and values."""
    kinds = {"geo": "geo_location", "device": "device_fingerprint", "resource": "resource_accessed"}
    keys = ["entity_id", *kinds.values()]
    defaults = {"geo": "typical_countries", "device": "typical_devices", "resource": "normal_resources"}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"),
                 F.col(c).isin(V.PROFILE_DEFAULTS[defaults[k]]).alias("is_default"))
        for k, c in kinds.items()
    ])).alias("_p")
    asked = df.select(*keys).distinct().select(*keys, pairs).select(*keys, "_p.*")
    tested = asked.join(typical.withColumn("_seen", F.lit(True)), ["entity_id", "kind", "value"], "left")
    return tested.groupBy(*keys).agg(
        *[F.max((F.col("kind") == k) & F.col("_seen").isNull()).alias(f"unusual_{k}") for k in kinds],
        *[F.max((F.col("kind") == k) & F.col("is_default")).alias(f"_default_{k}") for k in kinds],
    )


def _working_hours(hour: Column) -> Column:
    low, high = F.col("hour_low"), F.col("hour_high")
    away = F.least(F.abs(hour - low), F.abs(hour - high))
    return F.when((hour < low) | (hour > high), F.least(F.lit(1.0), away / 6.0))


def deviation(df: DataFrame, history: DataFrame) -> DataFrame:
    """Five weighted checks of each event against its entity's history.

    Adds ``c_<check>`` contributions (unrounded), ``deviation_raw`` and ``deviation_percentage``. Membership flags
    and profile are joined on the reduced table of combinations first, so the log is joined once.
    """
    keys = ["entity_id", "geo_location", "device_fingerprint", "resource_accessed"]
    statistics = profile_statistics(history).withColumnRenamed("department", "profile_department")
    places = history.select("entity_id", "geo_location").distinct().groupBy("entity_id").agg(
        F.sort_array(F.collect_set("geo_location")).alias("typical_countries")
    )
    facts = unusual_flags(df, typical_values(history)).join(
        statistics.join(places, "entity_id"), "entity_id", "left"
    )
    out = with_defaults(df.join(facts, keys, "left"))
    known = F.col("total_historical_events") > 0
    for kind in ("geo", "device", "resource"):
        # Without history the default profile decides.
        out = out.withColumn(
            f"unusual_{kind}", F.when(known, F.col(f"unusual_{kind}")).otherwise(~F.col(f"_default_{kind}"))
        ).drop(f"_default_{kind}")

    hour = F.hour("timestamp")
    mean = F.round("avg_bytes_transferred", 1)
    volume = F.col("bytes_transferred").cast("double")
    times_mean = F.round(volume / F.greatest(F.lit(1.0), mean), 1)
    exceeds = volume > mean * 3.0
    parts = {
        "off_hours_access": F.coalesce(_working_hours(hour), F.lit(0.0)),
        "unusual_location": F.when(F.col("unusual_geo"), 1.0).otherwise(0.0),
        "unrecognized_device": F.when(F.col("unusual_device"), 1.0).otherwise(0.0),
        "sensitive_resource_access": F.when(F.col("unusual_resource"), 1.0).otherwise(0.0),
        "abnormal_data_volume": F.when(
            exceeds, F.least(F.lit(1.0), (times_mean - 1.0) / 10.0)
        ).otherwise(0.0),
    }
    out = out.withColumns({f"c_{k}": v * F.lit(CHECKS[k]) for k, v in parts.items()}).withColumns({
        "is_off_profile_hours": (hour < F.col("hour_low")) | (hour > F.col("hour_high")),
        "is_volume_exceeded": exceeds,
        "times_mean": times_mean,
    })
    raw = sum((F.col(f"c_{k}") for k in CHECKS), F.lit(0.0)) / sum(CHECKS.values()) * 100.0
    return out.withColumn("deviation_raw", raw).withColumn("deviation_percentage", F.round("deviation_raw", 1))


def deviation_details(df: DataFrame) -> DataFrame:
    """Detail records, contribution map, summary and explanation of evaluated events."""
    hour = F.hour("timestamp")

    def detail(factor, severity, text, weight):
        return F.struct(
            F.lit(factor).alias("factor"), severity.alias("severity"), text.alias("detail"),
            F.lit(weight).alias("weight_pct"),
        )

    details = compact(
        F.when(F.col("is_off_profile_hours"), detail(
            "Off-Hours Access",
            F.when(F.col("c_off_hours_access") / 20.0 > 0.6, "High").otherwise("Medium"),
            F.format_string("Access at %02d:00 outside baseline working hours (%02d:00–%02d:00)",
                            hour, F.col("hour_low"), F.col("hour_high")), 20.0)),
        F.when(F.col("unusual_geo"), detail(
            "Unusual Geographic Location", F.lit("Critical"),
            F.format_string("Access from '%s' not in typical country list (%s)", F.col("geo_location"),
                            F.array_join("typical_countries", ", ")), 25.0)),
        F.when(F.col("unusual_device"), detail(
            "Unrecognized Device", F.lit("Medium"),
            F.format_string("Device '%s' not in baseline approved devices", F.col("device_fingerprint")), 15.0)),
        F.when(F.col("unusual_resource"), detail(
            "Unusual Resource Access", F.lit("High"),
            F.format_string("Resource '%s' never accessed previously by this user", F.col("resource_accessed")), 20.0)),
        F.when(F.col("is_volume_exceeded"), detail(
            "Abnormal Data Volume Exfiltration",
            F.when(F.col("times_mean") > 5.0, "Critical").otherwise("High"),
            F.format_string("Transferred %s bytes (%.1fx higher than baseline mean of %s bytes)",
                            thousands(F.col("bytes_transferred")), F.col("times_mean"),
                            thousands(F.round("avg_bytes_transferred", 1))), 20.0)),
    )
    out = df.withColumn("top_deviations", details)
    pct = F.format_string("%.1f", "deviation_percentage")
    aligned = F.size("top_deviations") == 0
    drivers = F.array_join(F.transform("top_deviations", lambda d: d["factor"]), ", ")
    return out.withColumns({
        "risk_contributions": F.map_from_arrays(
            F.array(*[F.lit(k) for k in CHECKS]), F.array(*[F.round(f"c_{k}", 1) for k in CHECKS])
        ),
        "behavior_summary": F.when(aligned, "Normal Behavioral Alignment").otherwise(
            F.format_string("High Behavioral Shift (%s%% Deviation)", pct)
        ),
        "human_explanation": F.when(aligned, F.format_string(
            "Entity '%s' behavior aligns 100%% with historical baseline parameters.", F.col("entity_id")
        )).otherwise(F.format_string(
            "Entity '%s' demonstrated a %s%% overall behavioral deviation. Primary anomaly drivers: %s. "
            "Access event flagged for security analyst review.", F.col("entity_id"), pct, drivers,
        )),
    })


def deviation_band(percentage: Column) -> Column:
    return F.when(percentage > 50, "high").when(percentage > 25, "medium").otherwise("low")
