"""Rule detectors for the known attack patterns. Thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import HOUR, MINUTE, flag
from ..functions.timeline import HotKeys, Trailing, TrailingDistinct, with_trailing


def brute_force(df: DataFrame, failures: int = 10, minutes: int = 5, hot: HotKeys | None = None) -> DataFrame:
    """Events that complete a burst of password failures of one entity from one address."""
    failed = flag((F.col("auth_method") == "password") & (F.col("auth_status") == "failure"))
    m = Trailing("password_failures", failed, minutes * MINUTE, inclusive=True)
    narrow = df.select("event_id", "timestamp", "entity_id", "source_ip", "auth_method", "auth_status")
    return with_trailing(narrow, ["entity_id", "source_ip"], [m], hot).where(
        F.col("password_failures") >= failures
    ).select("event_id", "timestamp", "entity_id", "source_ip", "password_failures")


def impossible_travel(traveled: DataFrame, speed_kmh: float = 500.0, gap_minutes: float = 120.0) -> DataFrame:
    """Consecutive events less than two hours apart that need more than 500 km/h."""
    gap = F.col("minutes_since_last")
    return traveled.where((gap >= 0) & (gap < gap_minutes) & (F.col("geo_velocity_kmh") > speed_kmh)).select(
        "event_id", "entity_id", "geo_location", "minutes_since_last", "geo_distance_km", "geo_velocity_kmh"
    )


def credential_stuffing(
    df: DataFrame, entities: int = 6, failure_share: float = 0.85, hot: HotKeys | None = None
) -> DataFrame:
    """Addresses that try many accounts within an hour, nearly all of them failing."""
    measures = [
        TrailingDistinct("entities_1h", "entity_id", HOUR),
        Trailing("failures_1h", flag(F.col("auth_status") == "failure"), HOUR, inclusive=True),
        Trailing("events_1h", F.lit(1), HOUR, inclusive=True),
    ]
    narrow = df.select("event_id", "timestamp", "source_ip", "entity_id", "auth_status")
    counted = with_trailing(narrow, "source_ip", measures, hot)
    share = F.col("failures_1h") / F.col("events_1h")
    return counted.where((F.col("entities_1h") >= entities) & (share >= failure_share)).select(
        "event_id", "timestamp", "source_ip", "entities_1h", "failures_1h", "events_1h"
    )


def lateral_movement(novel: DataFrame) -> DataFrame:
    """Accesses to a new resource in a new category, per entity and day."""
    hits = novel.where((F.col("resource_novelty") == 1) & (F.col("category_novelty") == 1))
    return hits.groupBy("entity_id", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("novel_accesses"),
        F.count_distinct("resource_category").alias("categories"),
        F.sum("suspicious_cmd_flag").alias("suspicious_sessions"),
    )


def os_family(c: Column) -> Column:
    """Family of an operating system name: its first word, with Linux distributions and phones grouped."""
    return (
        F.when(c.startswith("Windows"), "windows")
        .when(c.startswith("macOS"), "macos")
        .when(c.startswith("Android") | c.startswith("iOS"), "mobile")
        .when(c.isin("unknown", ""), "unknown")
        .otherwise("linux")
    )


def device_spoofing(novel: DataFrame, train: DataFrame) -> DataFrame:
    """Unknown devices whose OS family the entity has not used before."""
    families = train.select("entity_id", os_family(F.col("device_os")).alias("os_family")).distinct()
    unknown = novel.where(F.col("device_novelty") == 1).withColumn("os_family", os_family(F.col("device_os")))
    return unknown.join(families, ["entity_id", "os_family"], "left_anti").select(
        "event_id", "entity_id", "device_fingerprint", "device_os", "os_family"
    )


def low_and_slow(df: DataFrame, days: int = 5, categories=("finance_data", "hr_data", "infra_config")) -> DataFrame:
    """Entities that take sensitive data at night on several days, in rising amounts."""
    hour = F.hour("timestamp")
    night = (hour >= 22) | (hour <= 5)
    picked = df.where(night & F.col("action_type").isin("read", "download") & F.col("resource_category").isin(*categories))
    daily = picked.groupBy("entity_id", F.to_date("timestamp").alias("day")).agg(
        F.sum("bytes_transferred").alias("bytes"), F.count(F.lit(1)).alias("accesses")
    )
    number = F.unix_date("day").cast("double")
    return daily.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("bytes").alias("total_bytes"),
        F.regr_slope(F.col("bytes").cast("double"), number).alias("bytes_per_day_slope"),
    ).where((F.col("days") >= days) & (F.col("bytes_per_day_slope") > 0))


def insider_drift(df: DataFrame, weeks: int = 2) -> DataFrame:
    """Runs of consecutive weeks in each of which an entity opened resources for the first time.

    An entity's first week is left out: everything is new then. Windows run over weeks, not events.
    """
    monday = F.date_trunc("week", "timestamp").cast("date")
    first_seen = df.groupBy("entity_id", "resource_accessed").agg(F.min(monday).alias("week"))
    weekly = first_seen.groupBy("entity_id", "week").agg(F.count(F.lit(1)).alias("new_resources"))
    by_entity = W.partitionBy("entity_id")
    ordered = by_entity.orderBy("week")
    number = (F.unix_date("week") / 7).cast("bigint")
    later = weekly.withColumn("_start", F.min("week").over(by_entity)).where(F.col("week") > F.col("_start"))
    islands = later.withColumn("_island", number - F.row_number().over(ordered))
    return islands.groupBy("entity_id", "_island").agg(
        F.min("week").alias("from_week"), F.count(F.lit(1)).alias("weeks"),
        F.sum("new_resources").alias("new_resources"),
    ).where(F.col("weeks") >= weeks).drop("_island")
