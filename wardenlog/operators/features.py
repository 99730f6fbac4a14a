"""Per-event features. Each step is a ``DataFrame -> DataFrame`` function; ``event_features`` chains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import flag, haversine_km, lookup, micros, ratio
from ..functions.timeline import HotKeys, with_previous
from .baseline import KNOWN_KINDS, VALUE_COLUMNS, unpivot_values

NOVELTY_COLUMNS = [f"{k}_novelty" for k in KNOWN_KINDS]
MAX_SPEED_KMH = 50_000
MAX_BYTES_PER_SECOND = 1_000_000.0
COLD_START_EVENTS = 10

# Feature columns in the order of the engineered dataset.
EVENT_FEATURES = [
    "hour_of_day", "day_of_week", "is_weekend", "is_off_hours", "minutes_since_last",
    "geo_distance_km", "geo_velocity_kmh", *NOVELTY_COLUMNS,
    "hour_zscore", "session_duration_zscore", "bytes_zscore",
    "suspicious_cmd_flag", "command_diversity", "resource_sensitivity", "auth_failure_flag",
    "risk_multiplier", "bytes_per_second", "auth_method_change", "is_cold_start",
]


def hour_is_off(hour: Column) -> Column:
    return (hour < 8) | (hour > 19)


def calendar(df: DataFrame) -> DataFrame:
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    return df.withColumns({
        "hour_of_day": hour.cast("bigint"),
        "day_of_week": day.cast("bigint"),
        "is_weekend": flag(day >= 5),
        "is_off_hours": flag(hour_is_off(hour)),
    })


def travel(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Minutes, distance and speed since the entity's previous event, from one ordered pass."""
    df = with_previous(
        df, "entity_id", {"timestamp": "_prev_time", "geo_lat": "_prev_lat", "geo_lon": "_prev_lon"}, hot=hot
    )
    minutes = (micros("timestamp") - micros("_prev_time")) / F.lit(60e6)
    km = haversine_km(F.col("_prev_lat"), F.col("_prev_lon"), F.col("geo_lat"), F.col("geo_lon"))
    df = df.withColumns({
        "minutes_since_last": F.coalesce(minutes, F.lit(-1.0)),
        "geo_distance_km": F.coalesce(km, F.lit(0.0)),
    })
    hours = F.col("minutes_since_last") / 60
    # The first event has distance 0, hence speed 0 whatever the divisor.
    speed = F.when(hours == 0, F.lit(0.0)).otherwise(F.least(F.col("geo_distance_km") / hours, F.lit(MAX_SPEED_KMH)))
    first = F.col("_prev_time").isNull()
    return df.withColumn("geo_velocity_kmh", F.when(first, F.lit(0.0)).otherwise(speed)).drop(
        "_prev_time", "_prev_lat", "_prev_lon"
    )


def novelty_of_combinations(df: DataFrame, known: DataFrame) -> DataFrame:
    """Novelty flags per distinct (entity, values) combination of the log.

    The log is reduced to its distinct combinations with map-side aggregation; only those meet the known values,
    in one join, so five membership tests cost neither five shuffles of the log nor arrays of known values.
    """
    combos = df.select("entity_id", *VALUE_COLUMNS).distinct()
    asked = unpivot_values(combos, ["entity_id", *VALUE_COLUMNS])
    tested = asked.join(known.withColumn("_known", F.lit(1)), ["entity_id", "kind", "value"], "left")
    flags = [
        F.max(flag((F.col("kind") == k) & F.col("_known").isNull())).alias(f"{k}_novelty") for k in KNOWN_KINDS
    ]
    return tested.groupBy("entity_id", *VALUE_COLUMNS).agg(*flags)


def novelty(df: DataFrame, known: DataFrame) -> DataFrame:
    """Five flags: the value was not seen for this entity in training."""
    flags = novelty_of_combinations(df, known)
    return df.join(flags, ["entity_id", *VALUE_COLUMNS], "left").withColumns(
        {c: F.coalesce(c, F.lit(1)).cast("bigint") for c in NOVELTY_COLUMNS}
    )


def z_score(value: Column, name: str) -> Column:
    z = (value - F.col(f"mean_{name}")) / F.col(f"std_{name}")
    return F.coalesce(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)), F.lit(0.0))


def z_scores(df: DataFrame) -> DataFrame:
    """Deviations from the entity's baseline, whose columns are already attached."""
    return df.withColumns({
        "hour_zscore": z_score(F.hour("timestamp"), "hour"),
        "session_duration_zscore": z_score(F.col("session_duration"), "session_duration"),
        "bytes_zscore": z_score(F.col("bytes_transferred"), "bytes"),
    })


def commands(df: DataFrame) -> DataFrame:
    # One text per session: a keyword may span two commands.
    text = F.lower(F.array_join("command_list", " "))
    hit = F.lit(False)
    for keyword in V.SUSPICIOUS_KEYWORDS:
        hit = hit | F.contains(text, F.lit(keyword))
    count = F.size("command_list")
    return df.withColumns({
        "suspicious_cmd_flag": flag(hit),
        "command_diversity": ratio(F.size(F.array_distinct("command_list")), count),
    })


def sensitivity(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "resource_sensitivity": lookup(
            F.col("resource_category"), V.CATEGORY_SENSITIVITY, V.CATEGORY_SENSITIVITY_DEFAULT
        ),
        "auth_failure_flag": flag(F.col("auth_status") == "failure"),
    })


def risk_multiplier(df: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in NOVELTY_COLUMNS] + [F.col("is_off_hours")]
    return df.withColumn("risk_multiplier", sum(parts[1:], parts[0]))


def transfer_rate(df: DataFrame) -> DataFrame:
    rate = ratio(F.col("bytes_transferred"), F.col("session_duration"))
    return df.withColumn("bytes_per_second", F.least(rate, F.lit(MAX_BYTES_PER_SECOND)))


def identity_flags(df: DataFrame) -> DataFrame:
    """Change of authentication method and cold start, from the attached baseline."""
    return df.withColumns({
        "auth_method_change": flag(F.col("auth_method") != F.col("primary_auth_method")),
        "is_cold_start": flag(F.coalesce("event_count", F.lit(0)) < COLD_START_EVENTS),
    })


def attach_baselines(df: DataFrame, baselines: DataFrame) -> DataFrame:
    return df.join(baselines, "entity_id", "left")


def baseline_columns(baselines: DataFrame) -> list[str]:
    return [c for c in baselines.columns if c != "entity_id"]


def event_features(
    df: DataFrame, baselines: DataFrame, known: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """All per-event features of cleaned rows.

    Novelty flags and baseline are brought together on the reduced table of combinations, so the log itself is
    joined once.
    """
    facts = novelty_of_combinations(df, known).join(baselines, "entity_id", "left")
    out = (
        df.transform(calendar)
        .transform(travel, hot)
        .join(facts, ["entity_id", *VALUE_COLUMNS], "left")
        .withColumns({c: F.coalesce(c, F.lit(1)).cast("bigint") for c in NOVELTY_COLUMNS})
        .transform(z_scores)
        .transform(commands)
        .transform(sensitivity)
        .transform(risk_multiplier)
        .transform(transfer_rate)
        .transform(identity_flags)
    )
    return out.select(*df.columns, *EVENT_FEATURES)
