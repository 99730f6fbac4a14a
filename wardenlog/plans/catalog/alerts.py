"""Risk scores, explanations, recommendations, classification records that need no trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import fixed_values as V
from ...functions.timeline import find_hot_keys
from ...operators import classifier, explain, features, risk, windows
from ...sources import access_log as source
from .. import features as plan
from .registry import VIEWS, joined, joined_sql, log_of, query, rounded


def _case(key: str, table: dict, default) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(float(v))
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {q(default)} END"


# --- Composite risk over the stand-in scores --------------------------------------------------------

_BASE = "(0.40 * anomaly_score * 100.0 + 0.35 * classifier_confidence * 100.0 + 0.25 * least(1.0, risk_multiplier / 6.0) * 100.0)"
VIEWS["risky"] = f"""
SELECT event_id, attack_type, predicted_attack, label, anomaly_score, classifier_confidence,
  greatest(0.0, least(100.0, CASE
    WHEN predicted_attack IN ('lateral_movement', 'low_slow_exfiltration', 'impossible_travel') AND {_BASE} > 50 THEN greatest({_BASE}, 85.0)
    WHEN predicted_attack IN ('brute_force', 'credential_stuffing', 'device_spoofing') AND {_BASE} > 40 THEN greatest({_BASE}, 70.0)
    ELSE {_BASE} END)) AS risk_raw
FROM (SELECT s.*, CAST(substring(event_id, 5) AS BIGINT) % 7 AS risk_multiplier FROM scored s) q"""
VIEWS["levelled"] = """
SELECT *, CASE WHEN score >= 90 THEN 'Critical' WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT *, CAST(round_even(risk_raw, 0) AS BIGINT) AS score FROM risky) q"""


def _scored(spark, sf_dir):
    out = source.scored(source.access_log(spark, sf_dir))
    return out.withColumn("risk_multiplier", F.substring("event_id", 5, 20).cast("bigint") % 7)


def _risky(spark, sf_dir):
    return risk.composite_risk(_scored(spark, sf_dir), attack="predicted_attack")


@query("k1_composite_risk", "SELECT event_id, round(risk_raw, 6) AS risk_raw, score AS risk_score FROM levelled")
def k1(spark, sf_dir):
    return rounded(_risky(spark, sf_dir), "risk_raw").select("event_id", "risk_raw", "risk_score")


@query("k2_risk_level", "SELECT risk_level, count(*) AS events FROM levelled GROUP BY risk_level")
def k2(spark, sf_dir):
    return _risky(spark, sf_dir).groupBy("risk_level").agg(F.count(F.lit(1)).alias("events"))


@query("e3_recommendation", f"""
SELECT event_id, risk_level,
  CASE WHEN risk_level = 'Low' THEN 'Monitor' ELSE {_case("predicted_attack", {k: v[0] for k, v in V.RECOMMENDATIONS.items()}, "Monitor")} END AS recommended_action,
  CASE WHEN risk_level = 'Low' THEN '{V.LOW_RISK_RECOMMENDATION[1]}'
    ELSE {_case("predicted_attack", {k: v[1] for k, v in V.RECOMMENDATIONS.items()}, V.RECOMMENDATIONS["normal"][1])} END AS recommendation
FROM levelled""")
def e3(spark, sf_dir):
    return explain.recommendation(_risky(spark, sf_dir), "predicted_attack").select(
        "event_id", "risk_level", "recommended_action", "recommendation"
    )


_TECH = ["tactic", "technique_id", "technique_name", "technique_url"]


@query("e4_technique", "SELECT event_id, " + ", ".join(
    _case("attack_type", {k: v[i] for k, v in V.TECHNIQUES.items()}, V.TECHNIQUE_DEFAULT[i]) + f" AS {name}"
    for i, name in enumerate(_TECH)) + " FROM log WHERE label = 'anomaly'")
def e4(spark, sf_dir):
    log = source.access_log(spark, sf_dir).where(F.col("label") == "anomaly")
    return explain.technique(log).select("event_id", *_TECH)


@query("m16_severity", f"""
SELECT event_id, CASE WHEN classifier_confidence > 0.90 AND s = 'High' THEN 'Critical' ELSE s END AS severity
FROM (SELECT *, {_case("predicted_attack", V.ATTACK_SEVERITY, "High")} AS s FROM scored) q""")
def m16(spark, sf_dir):
    return source.scored(source.access_log(spark, sf_dir)).select(
        "event_id", classifier.severity(F.col("predicted_attack"), F.col("classifier_confidence")).alias("severity")
    )


_TOP5 = ["failed", "off_hours", "session_duration", "bytes_transferred", "geo_lat"]


@query("m17_prominent_features", f"""
SELECT event_id, array_to_string(list_slice(list_concat(
  list_filter([{', '.join(f"CASE WHEN abs({c}) > 0.01 THEN '{c}' END" for c in _TOP5)}], lambda x: x IS NOT NULL),
  list_filter([{', '.join(f"CASE WHEN abs({c}) <= 0.01 THEN '{c}' END" for c in _TOP5)}], lambda x: x IS NOT NULL)), 1, 3), ' | ') AS top_features
FROM log""")
def m17(spark, sf_dir):
    log = source.access_log(spark, sf_dir).withColumns({
        "failed": F.when(F.col("auth_status") == "failure", 1).otherwise(0),
        "off_hours": F.when(features.hour_is_off(F.hour("timestamp")), 1).otherwise(0),
    })
    return log.select("event_id", F.array_join(classifier.prominent_features(_TOP5), " | ").alias("top_features"))


_WEIGHTS = {"off_hours": 300.0, "session_duration": 0.5, "bytes_transferred": 0.01, "geo_lat": 2.0, "geo_lon": 1.0}


@query("m26_attributions", f"""
SELECT event_id, array_to_string(list_transform(list_slice(list_sort([
  {', '.join(f"{{'neg': -abs(CAST({c} AS DOUBLE)) * {w}, 'pos': {i}, 'name': '{explain.feature_label(c)}'}}" for i, (c, w) in enumerate(_WEIGHTS.items()))}
]), 1, 3), lambda s: s.name), ' | ') AS top_features FROM log""")
def m26(spark, sf_dir):
    log = source.access_log(spark, sf_dir).withColumn(
        "off_hours", F.when(features.hour_is_off(F.hour("timestamp")), 1).otherwise(0))
    top = explain.attributions(list(_WEIGHTS), list(_WEIGHTS.values()))
    return log.select("event_id", F.array_join(F.transform(top, lambda a: a["label"]), " | ").alias("top_features"))


# --- Evidence from engineered features ----------------------------------------------------------------

VIEWS["evident"] = f"""
SELECT event_id, geo_velocity_kmh, failed_auth_count_1h, {joined_sql([
    "CASE WHEN geo_velocity_kmh > 300 THEN 'Geo velocity exceeded threshold: ' || CAST(CAST(round_even(geo_velocity_kmh, 0) AS BIGINT) AS VARCHAR) || ' km/h (Physical max limit: 500 km/h)' END",
    "CASE WHEN device_novelty = 1 THEN 'Device fingerprint ''' || device_fingerprint || ''' not present in user''s historical profile' END",
    "CASE WHEN off_hours = 1 THEN 'Access initiated outside standard operating hours (08:00–19:00)' END",
    "CASE WHEN failed_auth_count_1h > 5 THEN 'High authentication failure rate: ' || CAST(CAST(failed_auth_count_1h AS BIGINT) AS VARCHAR) || ' failed attempts in past hour' END",
    "CASE WHEN unique_entities_per_ip_1h > 5 THEN 'Source IP ' || source_ip || ' attempted logins across ' || CAST(unique_entities_per_ip_1h AS VARCHAR) || ' distinct accounts within 1 hour' END",
    "CASE WHEN category_novelty = 1 THEN 'Access requested to uncharacteristic resource category ''' || resource_category || '''' END",
    "CASE WHEN suspicious_cmd_flag = 1 THEN 'Execution of suspicious administrative/recon command sequence: ' || command_sequence END",
])} AS deviations FROM windowed"""


def engineered_of(spark, sf_dir):
    log = log_of(spark, sf_dir)
    return plan.engineered(log)


@query("e1_evidence", """
SELECT event_id, CASE WHEN deviations = '' THEN 'Statistical deviation from standard user historical baseline' ELSE deviations END AS behavioral_deviations,
  CASE WHEN failed_auth_count_1h > 5 THEN CAST(failed_auth_count_1h AS DOUBLE) END AS failed_burst FROM evident""")
def e1(spark, sf_dir):
    out = explain.evidence(engineered_of(spark, sf_dir))
    return out.select("event_id", joined("behavioral_deviations"),
                      F.col("evidence.failed_auth_count_1h").cast("double").alias("failed_burst"))


# --- Dynamic risk -------------------------------------------------------------------------------------

_DEPT = _case("upper(department)", V.DEPARTMENT_SENSITIVITY, 0.5)
_RES = _case("replace(upper(resource_category), ' ', '_')", V.RESOURCE_SENSITIVITY, 0.5)
VIEWS["factored"] = f"""
SELECT event_id, entity_id, greatest(1, CAST(repeat_anomalies_24h AS BIGINT)) AS repeats, 0.0 AS f_behavior_deviation, 0.85 AS f_attack_confidence,
  {_DEPT} AS f_department_sensitivity, {_RES} AS f_resource_sensitivity,
  CASE WHEN hr < 7 OR hr > 19 THEN 1.0 ELSE 0.2 END AS f_time_of_day,
  CASE WHEN device_novelty = 1 THEN 1.0 ELSE 0.0 END AS f_unknown_device,
  CASE WHEN geo_novelty = 1 OR attack_type = 'impossible_travel' THEN 1.0 ELSE 0.0 END AS f_unknown_location,
  0.2 AS f_historical_risk, least(1.0, (greatest(1, CAST(repeat_anomalies_24h AS BIGINT)) - 1) / 5.0) AS f_repeated_anomalies
FROM windowed"""
_SUM = " + ".join(f"CAST(f_{k} AS DOUBLE) * CAST({w} AS DOUBLE)" for k, w in V.RISK_WEIGHTS)
VIEWS["dynamic"] = f"""
SELECT *, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  CASE WHEN s >= 80 THEN '{V.RISK_TIERS[0][3]}' WHEN s >= 60 THEN '{V.RISK_TIERS[1][3]}' WHEN s >= 35 THEN '{V.RISK_TIERS[2][3]}' ELSE '{V.RISK_TIERS[3][3]}' END AS action
FROM (SELECT *, round(raw, 1) AS s FROM (
  SELECT *, CAST(1.0 + least(repeats - 1, 5) * 0.08 AS DOUBLE) AS velocity_multiplier,
    least(100.0, ({_SUM}) * 100.0 * CAST(1.0 + least(repeats - 1, 5) * 0.08 AS DOUBLE)) AS raw FROM factored) q) r"""


def _dynamic_input(spark, sf_dir):
    log = log_of(spark, sf_dir)
    hot = find_hot_keys(log, "entity_id")
    fitted = plan.fit(log)
    novel = features.novelty(windows.repeat_anomalies(log, hot), fitted.known)
    return novel.withColumns({
        "is_unknown_device": F.col("device_novelty") == 1, "is_unknown_location": F.col("geo_novelty") == 1,
    })


_FACTORS = [f"f_{k}" for k, _ in V.RISK_WEIGHTS]


@query("k3_risk_factors", "SELECT event_id, repeats AS repeat_count, " + ", ".join(
    f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in _FACTORS) + " FROM factored")
def k3(spark, sf_dir):
    out = risk.risk_factors(_dynamic_input(spark, sf_dir))
    return rounded(out, *_FACTORS).select("event_id", "repeat_count", *_FACTORS)


@query("k4_dynamic_score", "SELECT event_id, round(velocity_multiplier, 6) AS velocity_multiplier, round(raw, 6) AS dynamic_risk_raw FROM dynamic")
def k4(spark, sf_dir):
    out = risk.dynamic_score(risk.risk_factors(_dynamic_input(spark, sf_dir)))
    return rounded(out, "velocity_multiplier", "dynamic_risk_raw").select("event_id", "velocity_multiplier", "dynamic_risk_raw")


@query("k5_dynamic_tier", "SELECT event_id, risk_tier, action AS recommended_soc_action FROM dynamic")
def k5(spark, sf_dir):
    out = _dynamic_input(spark, sf_dir).transform(risk.risk_factors).transform(risk.dynamic_score).transform(risk.dynamic_tier)
    return out.select("event_id", "risk_tier", "recommended_soc_action")


def _factor_structs():
    return ", ".join(
        f"{{'neg': -round(CAST(f_{k} AS DOUBLE) * {w} * 100.0, 1), 'pos': {i}, 'name': '{k.replace('_', ' ').title()}'}}"
        for i, (k, w) in enumerate(V.RISK_WEIGHTS))


@query("k6_top_factors", f"""
SELECT event_id, array_to_string(list_transform(list_filter(list_slice(list_sort([{_factor_structs()}]), 1, 3),
  lambda s: s.neg < 0), lambda s: s.name), ', ') AS top_factors FROM factored""")
def k6(spark, sf_dir):
    return risk.dynamic_risk(_dynamic_input(spark, sf_dir)).select("event_id", "top_factors")
