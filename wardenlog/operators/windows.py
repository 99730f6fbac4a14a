"""Rolling-window features per entity and per source address."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import DAY, HOUR, flag
from ..functions.timeline import HotKeys, Trailing, TrailingDistinct, with_trailing
from .features import hour_is_off

WINDOW_FEATURES = [
    "failed_auth_count_1h", "auth_failure_rate_1h", "failed_auth_count_24h", "bytes_total_24h",
    "off_hours_event_count_7d", "unique_resources_1h", "unique_resources_24h", "unique_geos_24h",
    "unique_entities_per_ip_1h",
]


def entity_measures() -> dict[str, Trailing | TrailingDistinct]:
    failed = flag(F.col("auth_status") == "failure")
    measures = [
        Trailing("failed_auth_count_1h", failed, HOUR),
        Trailing("total_events_1h", F.lit(1), HOUR),
        Trailing("failed_auth_count_24h", failed, DAY),
        Trailing("bytes_total_24h", F.col("bytes_transferred"), DAY),
        Trailing("off_hours_event_count_7d", flag(hour_is_off(F.hour("timestamp"))), 7 * DAY),
        TrailingDistinct("unique_resources_1h", "resource_accessed", HOUR),
        TrailingDistinct("unique_resources_24h", "resource_accessed", DAY),
        TrailingDistinct("unique_geos_24h", "geo_location", DAY),
    ]
    return {m.name: m for m in measures}


def ip_measures() -> dict[str, TrailingDistinct]:
    m = TrailingDistinct("unique_entities_per_ip_1h", "entity_id", HOUR)
    return {m.name: m}


def entity_windows(
    df: DataFrame, names: list[str] | None = None, hot: HotKeys | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Chosen entity measures in one sweep: one shuffle and one sort for all of them."""
    measures = entity_measures()
    return with_trailing(df, "entity_id", [measures[n] for n in names or measures], hot, source)


def with_failure_rate(df: DataFrame) -> DataFrame:
    rate = F.col("failed_auth_count_1h") / F.greatest(F.col("total_events_1h"), F.lit(1))
    return df.withColumn("auth_failure_rate_1h", rate)


def ip_windows(df: DataFrame, hot: HotKeys | None = None, source: DataFrame | None = None) -> DataFrame:
    return with_trailing(df, "source_ip", list(ip_measures().values()), hot, source)


def repeat_anomalies(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Anomalies of the entity in the trailing day, the current event included."""
    anomaly = Trailing("repeat_anomalies_24h", flag(F.col("label") == "anomaly"), DAY, inclusive=True)
    return with_trailing(df, "entity_id", [anomaly], hot)


def window_features(
    df: DataFrame,
    hot_entities: HotKeys | None = None,
    hot_ips: HotKeys | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """All window features; ``source`` is a cheaper frame with the same rows, for the distinct counts."""
    kept = df.columns
    out = (
        df.transform(entity_windows, None, hot_entities, source)
        .transform(with_failure_rate)
        .transform(ip_windows, hot_ips, source)
        .withColumn("bytes_total_24h", F.col("bytes_total_24h").cast("double"))
    )
    return out.select(*kept, *WINDOW_FEATURES)
