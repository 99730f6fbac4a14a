"""Risk scores: the composite score of an alert and the nine-factor dynamic score of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import lookup, round_half_even


# --- Composite score --------------------------------------------------------------------------------


def composite_raw(score: Column, confidence: Column, multiplier: Column, attack: Column) -> Column:
    base = (
        F.lit(0.40) * score * 100.0
        + F.lit(0.35) * confidence * 100.0
        + F.lit(0.25) * F.least(F.lit(1.0), multiplier / 6.0) * 100.0
    )
    kind = F.lower(attack)
    floored = (
        F.when(kind.isin(V.FLOOR_85_ATTACKS) & (base > 50), F.greatest(base, F.lit(85.0)))
        .when(kind.isin(V.FLOOR_70_ATTACKS) & (base > 40), F.greatest(base, F.lit(70.0)))
        .otherwise(base)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), floored))


def risk_level(score: Column) -> Column:
    return F.when(score >= 90, "Critical").when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def composite_risk(df: DataFrame, attack: str = "attack_type") -> DataFrame:
    """Adds ``risk_raw``, ``risk_score`` (whole number, half to even) and ``risk_level``."""
    raw = composite_raw(
        F.col("anomaly_score"), F.col("classifier_confidence"), F.col("risk_multiplier"), F.col(attack)
    )
    return (
        df.withColumn("risk_raw", raw)
        .withColumn("risk_score", round_half_even(F.col("risk_raw")))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )


# --- Dynamic score ----------------------------------------------------------------------------------


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _given(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def risk_factors(
    df: DataFrame,
    departments: dict[str, float] | None = None,
    resources: dict[str, float] | None = None,
) -> DataFrame:
    """Nine factors in [0, 1] as columns ``f_<factor>``; inputs that are absent take their defaults."""
    hour = F.hour("timestamp")
    resource = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("resource_category", "resource_accessed") if c in df.columns],
        F.lit("PUBLIC_PORTAL"),
    )
    repeats = F.greatest(F.lit(1), _given(df, "repeat_anomalies_24h", 1)).cast("bigint")
    factors = {
        "behavior_deviation": _unit(_given(df, "deviation_percentage", 0.0) / 100.0),
        "attack_confidence": _unit(_given(df, "confidence", 0.85)),
        "department_sensitivity": lookup(
            F.upper(_given(df, "department", "GENERAL")), departments or V.DEPARTMENT_SENSITIVITY,
            V.SENSITIVITY_DEFAULT,
        ),
        "resource_sensitivity": lookup(
            F.replace(F.upper(resource), F.lit(" "), F.lit("_")), resources or V.RESOURCE_SENSITIVITY,
            V.SENSITIVITY_DEFAULT,
        ),
        "time_of_day": F.when((hour < 7) | (hour > 19), 1.0).otherwise(0.2),
        "unknown_device": F.when(_given(df, "is_unknown_device", False), 1.0).otherwise(0.0),
        "unknown_location": F.when(
            _given(df, "is_unknown_location", False) | (_given(df, "attack_type", "normal") == "impossible_travel"),
            1.0,
        ).otherwise(0.0),
        "historical_risk": _unit(_given(df, "historical_risk_baseline", 20.0) / 100.0),
        "repeated_anomalies": F.least(F.lit(1.0), (repeats - 1) / 5.0),
    }
    return df.withColumn("repeat_count", repeats).withColumns({f"f_{k}": v for k, v in factors.items()})


def dynamic_score(df: DataFrame) -> DataFrame:
    """Weighted sum times the repeat multiplier, capped at 100; unrounded and rounded to one decimal."""
    weighted = sum((F.col(f"f_{k}") * F.lit(w) for k, w in V.RISK_WEIGHTS), F.lit(0.0))
    multiplier = 1.0 + F.least(F.col("repeat_count") - 1, F.lit(5)) * 0.08
    return (
        df.withColumn("velocity_multiplier", multiplier)
        .withColumn("dynamic_risk_raw", F.least(F.lit(100.0), weighted * 100.0 * F.col("velocity_multiplier")))
        .withColumn("composite_risk_score", F.round("dynamic_risk_raw", 1))
    )


def factor_breakdown() -> Column:
    """Per factor: normalised score, weight and contribution in points, in weight order."""
    return F.array(*[
        F.struct(
            F.lit(k).alias("factor"),
            F.round(F.col(f"f_{k}"), 2).alias("score_norm"),
            F.lit(round(w * 100.0, 1)).alias("weight_pct"),
            F.round(F.col(f"f_{k}") * w * 100.0, 1).alias("risk_contribution_pts"),
        )
        for k, w in V.RISK_WEIGHTS
    ])


def by_tier(score: Column, field: int) -> Column:
    out = None
    for tier in V.RISK_TIERS[:-1]:
        hit = score >= tier[0]
        out = F.when(hit, F.lit(tier[field])) if out is None else out.when(hit, F.lit(tier[field]))
    return out.otherwise(F.lit(V.RISK_TIERS[-1][field]))


def dynamic_tier(df: DataFrame) -> DataFrame:
    score = F.col("composite_risk_score")
    return df.withColumns({
        "risk_tier": by_tier(score, 1),
        "risk_color": by_tier(score, 2),
        "recommended_soc_action": by_tier(score, 3),
    })


def top_factors(k: int = 3) -> Column:
    """Names of the leading factors with a positive contribution; ties keep the weight order."""
    ranked = F.array_sort(F.transform(
        factor_breakdown(),
        # Negated points and position sort the largest first and keep the order among equals.
        lambda f, i: F.struct((-f["risk_contribution_pts"]).alias("neg"), i.alias("pos"), f["factor"].alias("factor")),
    ))
    leading = F.filter(F.slice(ranked, 1, k), lambda f: f["neg"] < 0)
    return F.transform(leading, lambda f: F.initcap(F.replace(f["factor"], F.lit("_"), F.lit(" "))))


def risk_explanation(df: DataFrame) -> DataFrame:
    text = F.format_string(
        "Composite Risk Score of %s/100 [%s] calculated via 9-factor dynamic weighting. "
        "Primary risk drivers: %s. Repeat velocity multiplier: %.2fx (%d events in 24h). "
        "Recommended SOC Action: %s.",
        F.format_string("%.1f", "composite_risk_score"), F.col("risk_tier"), F.array_join(top_factors(), ", "),
        F.col("velocity_multiplier"), F.col("repeat_count"), F.col("recommended_soc_action"),
    )
    return df.withColumn("top_factors", F.array_join(top_factors(), ", ")).withColumn("risk_explanation", text)


def dynamic_risk(df: DataFrame, **maps) -> DataFrame:
    return df.transform(risk_factors, **maps).transform(dynamic_score).transform(dynamic_tier).transform(risk_explanation)
