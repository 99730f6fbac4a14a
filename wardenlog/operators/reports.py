"""Report queries over the labelled log: aggregates, top-k, filters and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import haversine_km, pretty

HIGH_ATTACKS = ["brute_force", "impossible_travel", "credential_stuffing"]
CRITICAL_ATTACKS = ["lateral_movement", "low_slow_exfiltration"]


def anomalies(df: DataFrame) -> DataFrame:
    return df.where(F.col("label") == "anomaly")


def kpi(df: DataFrame) -> DataFrame:
    anomaly = F.col("label") == "anomaly"
    total, active = F.count(F.lit(1)), F.count_if(anomaly)
    return df.agg(
        total.alias("total_events"),
        (total - active).alias("normal_events"),
        (F.when(total > 0, (total - active) / total * 100)).alias("normal_pct"),
        active.alias("active_threats"),
        F.count_if(anomaly & F.col("attack_type").isin(HIGH_ATTACKS)).alias("high_alerts"),
        F.count_if(anomaly & F.col("attack_type").isin(CRITICAL_ATTACKS)).alias("critical_incidents"),
    )


def by_attack_type(df: DataFrame) -> DataFrame:
    counts = anomalies(df).groupBy("attack_type").agg(F.count(F.lit(1)).alias("incidents"))
    return counts.select(pretty("attack_type").alias("attack"), "incidents").orderBy(F.desc("incidents"), "attack")


def by_department(df: DataFrame) -> DataFrame:
    counts = anomalies(df).groupBy("department").agg(F.count(F.lit(1)).alias("incidents"))
    return counts.orderBy(F.desc("incidents"), "department")


def hourly_trend(df: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")
    return anomalies(df).groupBy(hour).agg(F.count(F.lit(1)).alias("incidents")).orderBy("hour")


def four_hour_buckets(df: DataFrame) -> DataFrame:
    start = (F.floor(F.hour("timestamp") / 4) * 4).cast("bigint").alias("start_hour")
    return anomalies(df).groupBy(start).agg(F.count(F.lit(1)).alias("incidents")).orderBy("start_hour")


def dataset_summary(df: DataFrame) -> DataFrame:
    """Totals per label and attack type against the whole data set, in one grouping pass.

    The grouped rows are at most labels times attack types; the totals come from a window over those.
    """
    from pyspark.sql import Window as W

    grouped = df.groupBy("label", "attack_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"),
    )
    everything = W.partitionBy(F.lit(0))
    total = F.sum("events").over(everything)
    anomalous = F.sum(F.when(F.col("label") == "anomaly", F.col("events")).otherwise(0)).over(everything)
    return grouped.select(
        "label", "attack_type", "events",
        (F.col("events") / total * 100).alias("pct_of_total"),
        total.alias("total_events"), anomalous.alias("anomaly_events"),
        (anomalous / total * 100).alias("anomaly_pct"),
        F.min("_lo").over(everything).alias("first_time"), F.max("_hi").over(everything).alias("last_time"),
    )


def population(df: DataFrame, baselines: DataFrame, cold_below: int = 10) -> DataFrame:
    """Entities and cold-start entities by type and role."""
    entities = df.select("entity_id", "entity_type", "entity_role").distinct()
    history = baselines.select("entity_id", "event_count")
    cold = F.coalesce("event_count", F.lit(0)) < cold_below
    return (
        entities.join(history, "entity_id", "left")
        .groupBy("entity_type", "entity_role")
        .agg(F.count_distinct("entity_id").alias("entities"),
             F.count_distinct(F.when(cold, F.col("entity_id"))).alias("cold_start_entities"))
    )


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct choices of the search form in long form (field, value)."""
    fields = ["attack_type", "department", "entity_id"]
    combos = anomalies(df).select(*fields).distinct()
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields
    ])).alias("_p")
    return combos.select(pairs).select("_p.*").distinct().orderBy("field", "value")


def search_incidents(
    df: DataFrame, attack_type: str | None = None, department: str | None = None, entity: str | None = None
) -> DataFrame:
    """Anomalies by exact attack type and department, and entity id matching a pattern in any case."""
    found = anomalies(df)
    if attack_type:
        found = found.where(F.col("attack_type") == attack_type)
    if department:
        found = found.where(F.col("department") == department)
    if entity:
        found = found.where(F.col("entity_id").rlike(f"(?i){entity}"))
    return found.select(
        "event_id", "timestamp", "entity_id", F.col("attack_type").alias("threat_category"), "source_ip",
        F.col("geo_location").alias("location"), F.col("resource_accessed").alias("resource_targeted"),
    )


def status_badge():
    status = F.col("status")
    return (
        F.when(status == "FALSE_POSITIVE", "FALSE POSITIVE")
        .when(status == "RESOLVED", "RESOLVED")
        .when(status == "UNDER_INVESTIGATION", "INVESTIGATING")
        .when(F.col("label") == "anomaly", "ANOMALY")
        .otherwise("NORMAL")
    )


def latest_events(df: DataFrame, n: int = 20) -> DataFrame:
    """The latest events with their badge; a bounded top-k."""
    return df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n).select(
        "event_id", status_badge().alias("badge"),
        F.substring(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), 1, 19).alias("time"),
        "entity_id", "department", "source_ip", "geo_location", "resource_accessed", "action_type",
        pretty("attack_type").alias("threat_category"),
    )


def entity_timeline(df: DataFrame, entity_id: str) -> DataFrame:
    return df.where(F.col("entity_id") == entity_id).select(
        "event_id", "timestamp", "action_type", "resource_accessed", "source_ip", "geo_location", "label",
        "attack_type", "status",
        F.when(F.col("label") == "anomaly", 12).otherwise(7).cast("bigint").alias("marker_size"),
    ).orderBy("timestamp", "event_id")


def geo_points(df: DataFrame) -> DataFrame:
    located = df.where(F.col("geo_lat").isNotNull() & F.col("geo_lon").isNotNull())
    return located.select(
        "event_id", "entity_id", "geo_location", "geo_lat", "geo_lon", "label", "attack_type", "source_ip",
        F.when(F.col("label") == "anomaly", 12).otherwise(4).cast("bigint").alias("marker_size"),
    )


def recent_audit(audit: DataFrame, n: int = 10) -> DataFrame:
    return audit.orderBy(F.desc("timestamp"), F.desc("incident_id")).limit(n)


def active_incidents(df: DataFrame, n: int = 50) -> DataFrame:
    return anomalies(df).select("event_id", "timestamp").orderBy("timestamp", "event_id").limit(n)


def far_places(df: DataFrame, km: float = 2000.0) -> DataFrame:
    """Observed locations with every known place farther away than ``km``.

    The log is first reduced to its locations; each is compared with the fixed list of places as an array.
    """
    seen = df.groupBy("geo_location", "geo_lat", "geo_lon").agg(F.count(F.lit(1)).alias("events"))
    places = F.array(*[
        F.struct(F.lit(p).alias("far_place"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
        for p, lat, lon in V.PLACES
    ])
    pairs = seen.withColumn("_p", F.explode(places)).select("geo_location", "geo_lat", "geo_lon", "events", "_p.*")
    distance = haversine_km(F.col("geo_lat"), F.col("geo_lon"), F.col("lat"), F.col("lon"))
    return pairs.withColumn("distance_km", distance).where(F.col("distance_km") > km).select(
        "geo_location", "far_place", "distance_km", "events"
    )
