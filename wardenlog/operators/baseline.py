"""Per-entity baselines learnt from the training part of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# kind of known value -> event column
KNOWN_KINDS = {
    "geo": "geo_location",
    "device": "device_fingerprint",
    "resource": "resource_accessed",
    "category": "resource_category",
    "protocol": "protocol",
}
VALUE_COLUMNS = list(KNOWN_KINDS.values())
# standard deviation assumed for an entity with a single event
SINGLE_EVENT_STD = {"hour": 4.0, "session_duration": 600.0, "bytes": 10000.0}


def _measures() -> dict[str, Column]:
    return {
        "hour": F.hour("timestamp").cast("double"),
        "session_duration": F.col("session_duration").cast("double"),
        "bytes": F.col("bytes_transferred").cast("double"),
    }


def numeric_baselines(train: DataFrame) -> DataFrame:
    """Mean and guarded sample deviation of hour, duration and bytes, event count and usual auth method."""
    measures = _measures()
    aggregates = [F.count(F.lit(1)).alias("event_count")]
    for name, value in measures.items():
        aggregates += [F.avg(value).alias(f"mean_{name}"), F.stddev_samp(value).alias(f"raw_std_{name}")]
    return train.groupBy("entity_id").agg(*aggregates)


def daily_moments(log: DataFrame) -> DataFrame:
    """Mergeable state of the numeric baselines: a row for each entity and day with the number of events, and for each measure
    its count, mean and sum of squared deviations.

    Days are added by appending their rows and taken away by leaving them out; the log itself is not read again.
    """
    aggregates = [F.count(F.lit(1)).alias("event_count")]
    for name, value in _measures().items():
        aggregates += [F.count(value).alias(f"n_{name}"), F.avg(value).alias(f"mean_{name}"),
                       (F.var_pop(value) * F.count(value)).alias(f"m2_{name}")]
    return log.groupBy("entity_id", F.to_date("timestamp").alias("event_date")).agg(*aggregates)


def merge_moments(days: DataFrame) -> DataFrame:
    """The numeric baselines of the events behind all rows of ``daily_moments``; an entity's day may have several rows.

    Squared deviations within the rows and between their means and the entity's are added, which loses no digits as
    differences of sums of squares would.
    """
    names = list(SINGLE_EVENT_STD)
    totals = [F.sum(f"n_{m}").alias(f"_n_{m}") for m in names]
    means = [(F.sum(F.col(f"n_{m}") * F.col(f"mean_{m}")) / F.sum(f"n_{m}")).alias(f"_mean_{m}") for m in names]
    whole = days.groupBy(F.col("entity_id").alias("_entity")).agg(F.sum("event_count").alias("_events"), *totals, *means)
    spread = [
        F.sum(F.col(f"m2_{m}") + F.col(f"n_{m}") * F.pow(F.col(f"mean_{m}") - F.col(f"_mean_{m}"), F.lit(2.0))).alias(f"_m2_{m}")
        for m in names
    ]
    merged = days.join(whole, F.col("entity_id").eqNullSafe(F.col("_entity"))).groupBy("entity_id").agg(
        F.max("_events").alias("event_count"), *[F.max(f"_{c}_{m}").alias(f"_{c}_{m}") for m in names for c in ("n", "mean")], *spread)
    columns = []
    for m in names:
        deviation = F.when(F.col(f"_n_{m}") > 1, F.sqrt(F.col(f"_m2_{m}") / (F.col(f"_n_{m}") - 1)))
        columns += [F.col(f"_mean_{m}").alias(f"mean_{m}"), deviation.alias(f"raw_std_{m}")]
    return merged.select("entity_id", "event_count", *columns)


def guard_deviations(stats: DataFrame) -> DataFrame:
    """Replace undefined deviations: one event -> an assumed value; zero or null -> 1."""
    for name, assumed in SINGLE_EVENT_STD.items():
        raw = F.col(f"raw_std_{name}")
        guarded = (
            F.when(F.col("event_count") == 1, F.lit(assumed))
            .when(F.coalesce(raw, F.lit(0.0)) == 0, F.lit(1.0))
            .otherwise(raw)
        )
        stats = stats.withColumn(f"std_{name}", guarded).drop(f"raw_std_{name}")
    return stats


def primary_auth_method(train: DataFrame) -> DataFrame:
    """Most frequent authentication method per entity; ties go to the smallest name.

    Two counting aggregates: the first combines in the map tasks, the second sees one row per method.
    """
    counts = train.groupBy("entity_id", "auth_method").agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_n"), "auth_method"))
    return counts.groupBy("entity_id").agg(best.alias("_b")).select(
        "entity_id", F.col("_b.auth_method").alias("primary_auth_method")
    )


def entity_baselines(train: DataFrame) -> DataFrame:
    """One row per entity: guarded statistics and primary authentication method.

    Both sides are hash aggregates by entity, so the join adds no shuffle of the log.
    """
    return guard_deviations(numeric_baselines(train)).join(primary_auth_method(train), "entity_id")


def known_values(train: DataFrame) -> DataFrame:
    """Values seen per entity in long form (entity_id, kind, value).

    The long form has no row that grows with an entity's history. Whole combinations are made distinct first:
    they combine in the map tasks, so the unpivoted values are few.
    """
    combos = train.select("entity_id", *VALUE_COLUMNS).distinct()
    return unpivot_values(combos, ["entity_id"]).distinct()


def unpivot_values(df: DataFrame, keep: list[str]) -> DataFrame:
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in KNOWN_KINDS.items()]
    return df.select(*keep, F.explode(F.array(*kinds)).alias("_kv")).select(*keep, "_kv.*")


def known_sets(train: DataFrame) -> DataFrame:
    """Known values as one sorted array per kind: the record form, for payloads and small entities."""
    sets = [
        F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(f"known_{k}s")
        for k in KNOWN_KINDS
    ]
    return known_values(train).groupBy("entity_id").agg(*sets)
