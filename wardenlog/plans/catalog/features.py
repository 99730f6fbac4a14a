"""Baselines, event features and rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.timeline import find_hot_keys
from ...functions.columns import haversine_km
from ...operators import baseline, features, windows
from ...scratch import scratch_path, written
from ...sources import access_log as source
from .. import features as plan
from .registry import KINDS, SUSPICIOUS, haversine, joined, log_of, query, r6, rounded, train_of

_STATS = ["hour", "session_duration", "bytes"]


_B1 = """
SELECT entity_id, count(*) AS event_count, round(avg(hr), 6) AS mean_hour, round(stddev_samp(hr), 6) AS raw_std_hour,
  round(avg(session_duration), 6) AS mean_session_duration, round(stddev_samp(session_duration), 6) AS raw_std_session_duration,
  round(avg(bytes_transferred), 6) AS mean_bytes, round(stddev_samp(bytes_transferred), 6) AS raw_std_bytes
FROM {} GROUP BY entity_id"""


def _b1_rounded(stats):
    return rounded(stats, *[f"{p}_{s}" for s in _STATS for p in ("mean", "raw_std")])


@query("b1_numeric_baselines", _B1.format("train"))
def b1(spark, sf_dir):
    return _b1_rounded(baseline.numeric_baselines(train_of(log_of(spark, sf_dir))))


@query("b1_merged_days", _B1.format("train"))
def b1_merged(spark, sf_dir):
    """From stored moments of days: those of even days of the month first, the others appended."""
    path = scratch_path(spark, "moments")
    train = train_of(log_of(spark, sf_dir))
    for part in (0, 1):
        baseline.daily_moments(train.where(F.dayofmonth("timestamp") % 2 == part)).write.mode("append").parquet(path)
    return _b1_rounded(baseline.merge_moments(spark.read.parquet(path)))


@query("b1_without_oldest_day", _B1.format("train, (SELECT min(CAST(timestamp AS DATE)) AS oldest FROM train) o WHERE CAST(timestamp AS DATE) > oldest"))
def b1_without(spark, sf_dir):
    """A day is taken away from the stored moments; the log is not read for it."""
    days = written(baseline.daily_moments(train_of(log_of(spark, sf_dir))), "moments")
    oldest = days.agg(F.min("event_date")).first()[0]
    return _b1_rounded(baseline.merge_moments(days.where(F.col("event_date") > F.lit(oldest))))


@query("b2_guarded_deviations", """
SELECT entity_id, round(std_hour, 6) AS std_hour, round(std_session_duration, 6) AS std_session_duration,
  round(std_bytes, 6) AS std_bytes FROM base""")
def b2(spark, sf_dir):
    stats = baseline.guard_deviations(baseline.numeric_baselines(train_of(log_of(spark, sf_dir))))
    return rounded(stats, *[f"std_{s}" for s in _STATS]).select("entity_id", *[f"std_{s}" for s in _STATS])


@query("b3_known_values", "SELECT entity_id, kind, value FROM known")
def b3(spark, sf_dir):
    return baseline.known_values(train_of(log_of(spark, sf_dir)))


@query("b3_known_sets", "SELECT entity_id, " + ", ".join(
    f"array_to_string(list_sort(list(DISTINCT {c})), ' | ') AS known_{k}s" for k, c in KINDS.items()
) + " FROM train GROUP BY entity_id")
def b3_sets(spark, sf_dir):
    sets = baseline.known_sets(train_of(log_of(spark, sf_dir)))
    return sets.select("entity_id", *[joined(f"known_{k}s") for k in KINDS])


@query("b4_primary_auth_method", "SELECT entity_id, primary_auth_method FROM auth_mode")
def b4(spark, sf_dir):
    return baseline.primary_auth_method(train_of(log_of(spark, sf_dir)))


@query("f1_calendar", """
SELECT event_id, hr AS hour_of_day, CAST(isodow(timestamp) - 1 AS BIGINT) AS day_of_week,
  CAST(CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend, CAST(off_hours AS BIGINT) AS is_off_hours
FROM log""")
def f1(spark, sf_dir):
    return features.calendar(source.access_log(spark, sf_dir)).select(
        "event_id", "hour_of_day", "day_of_week", "is_weekend", "is_off_hours"
    )


def _traveled(spark, sf_dir):
    log = source.access_log(spark, sf_dir).select("event_id", "timestamp", "entity_id", "geo_location", "geo_lat", "geo_lon")
    return features.travel(log, find_hot_keys(log, "entity_id"))


@query("f2_minutes_since_last", "SELECT event_id, minutes_since_last FROM traveled")
def f2(spark, sf_dir):
    return _traveled(spark, sf_dir).select("event_id", "minutes_since_last")


@query("f3_haversine_to_first_office", f"""
SELECT event_id, round({haversine("19.076", "72.8777", "geo_lat", "geo_lon")}, 6) AS km FROM log""")
def f3(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    return log.select("event_id", r6(
        haversine_km(F.lit(19.076), F.lit(72.8777), F.col("geo_lat"), F.col("geo_lon"))).alias("km"))


@query("f4_geo_distance", "SELECT event_id, round(geo_distance_km, 6) AS geo_distance_km FROM traveled")
def f4(spark, sf_dir):
    return rounded(_traveled(spark, sf_dir), "geo_distance_km").select("event_id", "geo_distance_km")


@query("f5_geo_velocity", "SELECT event_id, round(geo_velocity_kmh, 6) AS geo_velocity_kmh FROM traveled")
def f5(spark, sf_dir):
    return rounded(_traveled(spark, sf_dir), "geo_velocity_kmh").select("event_id", "geo_velocity_kmh")


_NOVELTY = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in features.NOVELTY_COLUMNS)


@query("f6_novelty", f"SELECT event_id, {_NOVELTY} FROM novel")
def f6(spark, sf_dir):
    log = log_of(spark, sf_dir)
    known = baseline.known_values(train_of(log))
    return features.novelty(log, known).select("event_id", *features.NOVELTY_COLUMNS)


_Z = ["hour_zscore", "session_duration_zscore", "bytes_zscore"]


@query("f7_z_scores", "SELECT event_id, " + ", ".join(f"round({z}, 6) AS {z}" for z in _Z) + " FROM featured")
def f7(spark, sf_dir):
    log = log_of(spark, sf_dir)
    stats = baseline.guard_deviations(baseline.numeric_baselines(train_of(log)))
    return rounded(features.z_scores(features.attach_baselines(log, stats)), *_Z).select("event_id", *_Z)


@query("f8_suspicious_commands", f"SELECT event_id, CAST(CASE WHEN {SUSPICIOUS} THEN 1 ELSE 0 END AS BIGINT) AS suspicious_cmd_flag FROM log")
def f8(spark, sf_dir):
    return features.commands(log_of(spark, sf_dir)).select("event_id", "suspicious_cmd_flag")


@query("f9_command_diversity", "SELECT event_id, round(command_diversity, 6) AS command_diversity FROM featured")
def f9(spark, sf_dir):
    return rounded(features.commands(log_of(spark, sf_dir)), "command_diversity").select("event_id", "command_diversity")


@query("f10_sensitivity", """
SELECT event_id, CAST(resource_sensitivity AS DOUBLE) AS resource_sensitivity, CAST(auth_failure_flag AS BIGINT) AS auth_failure_flag FROM featured""")
def f10(spark, sf_dir):
    return features.sensitivity(source.access_log(spark, sf_dir)).select(
        "event_id", "resource_sensitivity", "auth_failure_flag"
    )


@query("f11_risk_multiplier", "SELECT event_id, CAST(risk_multiplier AS BIGINT) AS risk_multiplier FROM featured")
def f11(spark, sf_dir):
    log = log_of(spark, sf_dir)
    novel = features.novelty(features.calendar(log), baseline.known_values(train_of(log)))
    return features.risk_multiplier(novel).select("event_id", "risk_multiplier")


@query("f12_bytes_per_second", "SELECT event_id, round(bytes_per_second, 6) AS bytes_per_second FROM featured")
def f12(spark, sf_dir):
    return rounded(features.transfer_rate(source.access_log(spark, sf_dir)), "bytes_per_second").select(
        "event_id", "bytes_per_second"
    )


@query("f13_identity_flags", """
SELECT event_id, CAST(auth_method_change AS BIGINT) AS auth_method_change, CAST(is_cold_start AS BIGINT) AS is_cold_start FROM featured""")
def f13(spark, sf_dir):
    log = log_of(spark, sf_dir)
    out = features.identity_flags(features.attach_baselines(log, baseline.entity_baselines(train_of(log))))
    return out.select("event_id", "auth_method_change", "is_cold_start")


# Minutes are whole microseconds over 6e7: equal doubles everywhere, while rounding would meet exact halves.
_FLOATS = ["geo_distance_km", "geo_velocity_kmh", *_Z, "command_diversity", "bytes_per_second"]
_INTS = [*features.NOVELTY_COLUMNS, "suspicious_cmd_flag", "auth_failure_flag", "risk_multiplier", "auth_method_change", "is_cold_start"]


def _event_features_of(log):
    fitted = plan.fit(log)
    return features.event_features(log, fitted.baselines, fitted.known, find_hot_keys(log, "entity_id"))


@query("f14_event_features", "SELECT event_id, hr AS hour_of_day, minutes_since_last, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FLOATS) + ", "
       + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _INTS) + " FROM featured")
def f14(spark, sf_dir):
    out = _event_features_of(log_of(spark, sf_dir))
    return rounded(out, *_FLOATS).select("event_id", "hour_of_day", "minutes_since_last", *_FLOATS, *_INTS)


def _windowed(spark, sf_dir, *names):
    log = source.access_log(spark, sf_dir).select(
        "event_id", "timestamp", "entity_id", "auth_status", "bytes_transferred", "resource_accessed", "geo_location"
    )
    return windows.entity_windows(log, list(names), find_hot_keys(log, "entity_id"))


def _register_window(key, name):
    @query(f"{key}_{name}", f"SELECT event_id, CAST({name} AS BIGINT) AS {name} FROM windowed")
    def run(spark, sf_dir):
        return _windowed(spark, sf_dir, name).select("event_id", name)


for _key, _name in [
    ("w1", "failed_auth_count_1h"), ("w2", "total_events_1h"), ("w4", "failed_auth_count_24h"),
    ("w6", "off_hours_event_count_7d"), ("w7", "unique_resources_1h"), ("w8", "unique_resources_24h"),
    ("w9", "unique_geos_24h"),
]:
    _register_window(_key, _name)


@query("w3_auth_failure_rate_1h", """
SELECT event_id, round(failed_auth_count_1h / greatest(total_events_1h, 1), 6) AS auth_failure_rate_1h FROM windowed""")
def w3(spark, sf_dir):
    counted = _windowed(spark, sf_dir, "failed_auth_count_1h", "total_events_1h")
    return rounded(windows.with_failure_rate(counted), "auth_failure_rate_1h").select("event_id", "auth_failure_rate_1h")


@query("w5_bytes_total_24h", "SELECT event_id, CAST(bytes_total_24h AS DOUBLE) AS bytes_total_24h FROM windowed")
def w5(spark, sf_dir):
    return _windowed(spark, sf_dir, "bytes_total_24h").select("event_id", F.col("bytes_total_24h").cast("double").alias("bytes_total_24h"))


@query("w10_unique_entities_per_ip_1h", "SELECT event_id, unique_entities_per_ip_1h FROM windowed")
def w10(spark, sf_dir):
    log = source.access_log(spark, sf_dir).select("event_id", "timestamp", "entity_id", "source_ip")
    return windows.ip_windows(log, find_hot_keys(log, "source_ip")).select("event_id", "unique_entities_per_ip_1h")


_W_INTS = [c for c in windows.WINDOW_FEATURES if c not in ("auth_failure_rate_1h", "bytes_total_24h")]


@query("w11_window_features", "SELECT event_id, "
       "round(failed_auth_count_1h / greatest(total_events_1h, 1), 6) AS auth_failure_rate_1h, "
       "CAST(bytes_total_24h AS DOUBLE) AS bytes_total_24h, "
       + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _W_INTS) + " FROM windowed")
def w11(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    out = windows.window_features(log, find_hot_keys(log, "entity_id"), find_hot_keys(log, "source_ip"))
    return rounded(out, "auth_failure_rate_1h").select("event_id", *windows.WINDOW_FEATURES)


@query("w12_repeat_anomalies_24h", "SELECT event_id, CAST(repeat_anomalies_24h AS BIGINT) AS repeat_anomalies_24h FROM windowed")
def w12(spark, sf_dir):
    log = source.access_log(spark, sf_dir).select("event_id", "timestamp", "entity_id", "label")
    return windows.repeat_anomalies(log, find_hot_keys(log, "entity_id")).select("event_id", "repeat_anomalies_24h")
