"""Schema validation of events and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import compact


def _not_in(column: str, allowed: list[str]) -> Column:
    c = F.col(column)
    message = F.concat(F.lit(f"Invalid {column}: "), F.coalesce(c, F.lit("None")))
    return F.when(c.isNull() | ~c.isin(allowed), message)


def _failed(column: str, failed: Column, what: str) -> Column:
    return F.when(failed, F.concat(F.lit(f"{what} {column}: "), F.col(column).cast("string")))


def event_errors() -> Column:
    """Error messages of an event, empty if valid."""
    return compact(
        _not_in("entity_type", V.ENTITY_TYPES),
        _not_in("entity_role", V.ENTITY_ROLES),
        _not_in("resource_category", V.RESOURCE_CATEGORIES),
        _not_in("auth_method", V.AUTH_METHODS),
        _not_in("auth_status", V.AUTH_STATUSES),
        _not_in("action_type", V.ACTION_TYPES),
        _not_in("protocol", V.PROTOCOLS),
        _failed("session_duration", F.col("session_duration") < 0, "Negative"),
        _failed("bytes_transferred", F.col("bytes_transferred") < 0, "Negative"),
        _failed("geo_lat", ~F.col("geo_lat").between(-90, 90), "Invalid"),
        _failed("geo_lon", ~F.col("geo_lon").between(-180, 180), "Invalid"),
    )


def label_errors() -> Column:
    return compact(_not_in("label", V.LABELS), _not_in("attack_type", V.ATTACK_TYPES))


def with_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", F.concat(event_errors(), label_errors()))


def validation_summary(df: DataFrame, first: int = 10) -> DataFrame:
    """The first bad rows in event order with their messages and the number of all bad rows."""
    bad = with_errors(df).where(F.size("errors") > 0).select("event_id", "errors")
    total = bad.agg(F.count(F.lit(1)).alias("bad_rows"))
    top = bad.orderBy("event_id").limit(first)
    # One row on the right: the count.
    return top.withColumn("_k", F.lit(1)).join(
        F.broadcast(total.withColumn("_k", F.lit(1))), "_k"
    ).drop("_k")
