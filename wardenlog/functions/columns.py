"""Small column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since the epoch; wall-clock times are read as UTC (session time zone UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def flag(condition: Column) -> Column:
    """1 or 0 as bigint; a null condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def ratio(num: Column, den: Column, when_zero: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(when_zero)).otherwise(num / den)


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Value of a small fixed table, or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def pretty(c: str | Column) -> Column:
    """``brute_force`` -> ``Brute Force``."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def pretty_attack(c: str | Column) -> Column:
    name = pretty(c)
    return F.when(name == "Low Slow Exfiltration", F.lit("Low & Slow Exfiltration")).otherwise(name)


def attack_key(c: str | Column) -> Column:
    """Back from a display name to the attack key."""
    lower = F.replace(F.lower(col(c)), F.lit(" "), F.lit("_"))
    return F.replace(lower, F.lit("&_"), F.lit(""))


def thousands(c: Column) -> Column:
    """Number with thousands separators and no decimals."""
    return F.format_number(c, 0)


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = (F.sin(half_lat) * F.sin(half_lat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon))
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
