"""Feature scaling and score normalisation. What is fitted are a few numbers per column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature; a constant feature is divided by 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def column(self, feature: str) -> Column:
        i = self.features.index(feature)
        value = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
        return (value - F.lit(self.means[i])) / F.lit(self.scales[i])

    def vector(self) -> Column:
        """All scaled features as one array of doubles."""
        return F.array(*[self.column(f) for f in self.features])


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    filled = [(f, F.coalesce(F.col(f).cast("double"), F.lit(0.0))) for f in features]
    row = df.agg(
        *[F.avg(v).alias(f"m_{f}") for f, v in filled], *[F.stddev_pop(v).alias(f"s_{f}") for f, v in filled]
    ).first()
    means = tuple(float(row[f"m_{f}"] or 0.0) for f in features)
    scales = tuple(float(row[f"s_{f}"] or 0.0) or 1.0 for f in features)
    return Scaler(tuple(features), means, scales)


@dataclass(frozen=True)
class MinMax:
    low: float
    high: float

    def apply(self, c: Column, clamp: bool = False) -> Column:
        """Scale to [0, 1]; a constant batch scores 0. Clamp when the range was fitted on other rows."""
        if not self.high > self.low:
            return c * 0.0
        scaled = (c - F.lit(self.low)) / F.lit(self.high - self.low)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) if clamp else scaled


def fit_min_max(df: DataFrame, *columns: str) -> list[MinMax]:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [MinMax(float(row[f"lo_{c}"] or 0.0), float(row[f"hi_{c}"] or 0.0)) for c in columns]


def normalise(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, fit_min_max(df, column)[0].apply(F.col(column)))
