"""Chronological attack storylines per entity, one row per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import compact, flag, lookup, pretty, thousands
from ..functions.timeline import HotKeys, with_position

_CRITICAL = ["lateral_movement", "low_slow_exfiltration"]
_RANK = {"INFO": 0, "HIGH": 1, "CRITICAL": 2}


def _severity():
    anomaly = F.lower("label") == "anomaly"
    critical = anomaly & F.lower("attack_type").isin(_CRITICAL)
    return F.when(critical, "CRITICAL").when(anomaly, "HIGH").otherwise("INFO")


def stages(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Numbered stages with title, severity and evidence. Long entities are numbered slice by slice."""
    numbered = with_position(df, "entity_id", "step_number", hot=hot)
    attack, action = F.lower("attack_type"), F.lower("action_type")
    anomaly = F.lower("label") == "anomaly"
    titles = F.create_map(*[F.lit(x) for kv in V.STAGE_TITLES.items() for x in kv])
    step = F.least(F.lit(5), F.col("step_number"))
    generic = F.when(anomaly, F.format_string("Stage %d: Behavioral Anomaly Detected", step)).otherwise(
        F.format_string("Stage %d: Baseline Telemetry Log", step)
    )
    severity = _severity()

    def evidence(label: str, column: str):
        c = F.col(column)
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))

    return numbered.select(
        "entity_id", "event_id", "timestamp", "step_number",
        F.coalesce(titles[attack], titles[action], generic).alias("stage_title"),
        pretty(action).alias("action"),
        pretty(attack).alias("attack_vector"),
        severity.alias("severity"),
        F.when(severity == "CRITICAL", "#dc2626").when(severity == "HIGH", "#ea580c").otherwise("#2563eb").alias("color"),
        compact(
            evidence("Geo Location", "geo_location"),
            evidence("Device Fingerprint", "device_fingerprint"),
            evidence("Resource Target", "resource_accessed"),
            F.when(F.col("bytes_transferred") > 0, F.concat(
                F.lit("Data Volume: "), thousands(F.col("bytes_transferred")), F.lit(" bytes"))),
        ).alias("evidence_chain"),
    )


def summaries(df: DataFrame) -> DataFrame:
    """Stage count, highest severity and narrative per entity; plain aggregates, no ordering needed."""
    severity = _severity()
    rank = lookup(severity, _RANK, 0)
    time = "yyyy-MM-dd HH:mm:ss"
    grouped = df.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_stages"),
        F.max(rank).alias("_rank"),
        F.date_format(F.min("timestamp"), time).alias("first_time"),
        F.date_format(F.max("timestamp"), time).alias("last_time"),
        F.count_if(severity != "INFO").alias("anomalous_stages"),
    )
    highest = F.when(F.col("_rank") == 2, "CRITICAL").when(F.col("_rank") == 1, "HIGH").otherwise("LOW")
    narrative = (
        F.when(F.col("total_stages") == 1, F.format_string(
            "Single event recorded for %s at %s.", F.col("entity_id"), F.col("first_time")))
        .when(F.col("anomalous_stages") > 0, F.format_string(
            "Incident storyline initiated at %s with initial entry. Progressed through %d chronological stages, "
            "escalating to a %s incident at %s. %d anomalous stages identified in the chain.",
            F.col("first_time"), F.col("total_stages"), F.col("highest_severity"), F.col("last_time"),
            F.col("anomalous_stages")))
        .otherwise(F.format_string(
            "Normal user activity trace across %d events between %s and %s.",
            F.col("total_stages"), F.col("first_time"), F.col("last_time")))
    )
    return grouped.withColumn("highest_severity", highest).withColumn("attack_narrative", narrative).select(
        "entity_id", "total_stages", "highest_severity", "anomalous_stages", "attack_narrative"
    )


def summary_of(df: DataFrame, entity_id: str) -> DataFrame:
    """Summary of one entity; an entity without activity yields the empty storyline."""
    wanted = df.sparkSession.range(1).select(F.lit(entity_id).alias("entity_id"))
    found = summaries(df.where(F.col("entity_id") == entity_id))
    return wanted.join(found, "entity_id", "left").select(
        "entity_id", F.coalesce("total_stages", F.lit(0)).alias("total_stages"),
        F.coalesce("highest_severity", F.lit("None")).alias("highest_severity"),
        F.coalesce("anomalous_stages", F.lit(0)).alias("anomalous_stages"),
        F.coalesce("attack_narrative", F.lit("No activity recorded for entity.")).alias("attack_narrative"),
    )


def milestones(stage_rows: DataFrame, first: int = 10) -> DataFrame:
    """Mark milestones and the remainder list.

    Milestones are the stages with an attack vector, or the first ten if an entity has none; the remainder starts
    after as many stages as there are milestones. Per-entity counts are aggregated and joined.
    """
    attacks = flag(F.col("attack_vector") != "Normal")
    counts = stage_rows.groupBy("entity_id").agg(F.sum(attacks).alias("_attacks"), F.count(F.lit(1)).alias("_n"))
    joined = stage_rows.join(counts, "entity_id", "left")
    has_attacks = F.col("_attacks") > 0
    size = F.when(has_attacks, F.col("_attacks")).otherwise(F.least(F.lit(first), F.col("_n")))
    chosen = F.when(has_attacks, F.col("attack_vector") != "Normal").otherwise(F.col("step_number") <= first)
    return joined.withColumns({
        "is_milestone": chosen, "is_remainder": F.col("step_number") > size,
    }).drop("_attacks", "_n")
