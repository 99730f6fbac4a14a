"""Sources and sinks, exercised by writing the given data and reading it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import fixed_values as V
from ...operators import clean, evaluate
from ...operators.identity import build_profiles
from ...schema import EVENT_COLUMNS, LABEL_COLUMNS
from ...scratch import scratch_path, written
from ...sources import access_log as source
from ...sources import files
from .models import engineered, the_classifier
from .registry import VIEWS, dirty_of, joined, query
from . import cleaning, identity, triage  # noqa: F401  (their views are used here)


@query("src1_read_events", """
SELECT event_id, timestamp, entity_id, command_sequence, geo_lat, bytes_transferred, is_vpn FROM valid""")
def src1(spark, sf_dir):
    path = scratch_path(spark, "events")
    dirty_of(spark, sf_dir).select(EVENT_COLUMNS).write.options(**files.CSV).csv(path)
    return clean.clean(files.read_events(spark, path)).select(
        "event_id", "timestamp", "entity_id", "command_sequence", "geo_lat", "bytes_transferred", "is_vpn"
    )


def broken_records(spark, sf_dir, columns):
    """The dirty log as CSV lines without header: every 43rd event's records lack three fields, every 41st's have one too many."""
    n = F.substring("event_id", 5, 99).cast("bigint")
    line = lambda *c: F.to_csv(F.struct(*c), {k: files.CSV[k] for k in ("escape", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace")})
    path = scratch_path(spark, "broken")
    dirty_of(spark, sf_dir).select(F.when(n % 43 == 0, line(*columns[:-3])).when(n % 41 == 0, line(*columns, F.lit("extra").alias("_extra")))
                                   .otherwise(line(*columns)).alias("value")).write.text(path)
    return path


VIEWS["numbered_valid"] = "SELECT *, CAST(substring(event_id, 5) AS BIGINT) AS n FROM valid"
VIEWS["broken"] = """
SELECT event_id, n % 43 <> 0 AS too_long FROM (SELECT event_id, CAST(substring(event_id, 5) AS BIGINT) AS n FROM dirty) q
WHERE n % 43 = 0 OR n % 41 = 0"""


def _split(spark, sf_dir):
    return files.split_records(files.read_events(spark, broken_records(spark, sf_dir, EVENT_COLUMNS), header=False, keep_bad=True))


@query("src1_accepted_records", """
SELECT event_id, timestamp, entity_id, command_sequence, bytes_transferred, is_vpn, user_agent FROM numbered_valid
WHERE n % 43 <> 0 AND n % 41 <> 0""")
def src1_accepted(spark, sf_dir):
    return clean.clean(_split(spark, sf_dir)[0]).select(
        "event_id", "timestamp", "entity_id", "command_sequence", "bytes_transferred", "is_vpn", "user_agent")


@query("src1_rejected_records", "SELECT event_id, too_long, count(*) AS records FROM broken GROUP BY 1, 2")
def src1_rejected(spark, sf_dir):
    rejected = _split(spark, sf_dir)[1]
    return rejected.groupBy(F.substring_index("record", ",", 1).alias("event_id"), F.endswith("record", F.lit(",extra")).alias("too_long")).agg(
        F.count(F.lit(1)).alias("records"))


_GOOD = "CAST(substring(event_id, 5) AS BIGINT) % 43 <> 0 AND CAST(substring(event_id, 5) AS BIGINT) % 41 <> 0"


@query("c8_statistics_with_rejects", f"""
SELECT (SELECT count(*) FROM broken) AS rows_rejected, count(*) AS rows_loaded, count(*) - count(DISTINCT event_id) AS duplicates_removed,
  (SELECT count(*) FROM valid WHERE {_GOOD}) AS final_rows FROM dirty WHERE {_GOOD}""")
def c8_rejects(spark, sf_dir):
    accepted, _, counts = _split(spark, sf_dir)
    found = clean.cleaning_statistics(accepted).withColumn("rows_rejected", F.lit(counts["rejected"]).cast("bigint"))
    return found.select("rows_rejected", "rows_loaded", "duplicates_removed", "final_rows")


@query("src2_read_labels", "SELECT event_id, label, attack_type, attack_subtype FROM access_log")
def src2(spark, sf_dir):
    path = scratch_path(spark, "labels")
    source.access_log(spark, sf_dir).select("event_id", *LABEL_COLUMNS).write.options(**files.CSV).csv(path)
    return files.read_labels(spark, path)


def profiles_of(log):
    """Entity profiles with list columns as list literals, derived from the log."""
    p = build_profiles(log)
    literal = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    kinds = log.groupBy("entity_id").agg(
        F.min("entity_type").alias("entity_type"), F.min("entity_role").alias("entity_role"),
        F.min("geo_location").alias("primary_geo"), F.min(F.to_date("timestamp")).alias("onboarding_date"),
        F.min("auth_method").alias("typical_auth_method"),
    )
    return p.join(kinds, "entity_id").select(
        "entity_id", "entity_type", "entity_role", "department", "primary_geo", F.lit("").alias("secondary_geo"),
        F.col("hour_low").alias("work_hours_start"), F.col("hour_high").alias("work_hours_end"),
        F.lit("[0, 1, 2, 3, 4]").alias("work_days"), literal("typical_devices").alias("known_devices"),
        literal("normal_resources").alias("typical_resources"), "typical_auth_method",
        F.floor("avg_session_duration").alias("avg_session_duration"),
        F.floor("avg_bytes_transferred").alias("avg_bytes_per_session"), "onboarding_date",
    )


@query("src3_read_profiles", """
SELECT p.entity_id, p.department, hour_low AS work_hours_start, '0 | 1 | 2 | 3 | 4' AS work_days,
  typical_devices AS known_devices, normal_resources AS typical_resources, CAST(floor(avg_session_duration) AS BIGINT) AS avg_session_duration
FROM profile_all p""")
def src3(spark, sf_dir):
    path = scratch_path(spark, "profiles")
    profiles_of(source.access_log(spark, sf_dir)).write.options(**files.CSV).csv(path)
    return files.read_profiles(spark, path).select(
        "entity_id", "department", F.col("work_hours_start").cast("bigint").alias("work_hours_start"),
        joined("work_days"), joined("known_devices"), joined("typical_resources"), "avg_session_duration",
    )


def _engineered_path(spark, sf_dir):
    path = scratch_path(spark, "engineered")
    files.write_engineered(engineered(spark, sf_dir)[0], path)
    return path


@query("src4_read_engineered", """
SELECT event_id, CAST(failed_auth_count_1h AS BIGINT) AS failed_auth_count_1h, CAST(risk_multiplier AS BIGINT) AS risk_multiplier
FROM windowed""")
def src4(spark, sf_dir):
    data = files.read_engineered(spark, _engineered_path(spark, sf_dir))
    # Only three columns are read.
    return data.select("event_id", "failed_auth_count_1h", "risk_multiplier")


@query("snk1_write_engineered", """
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, count(*) AS events, CAST(sum(unique_resources_24h) AS BIGINT) AS resources,
  CAST(sum(off_hours_event_count_7d) AS BIGINT) AS off_hours, CAST(sum(risk_multiplier) AS BIGINT) AS risk,
  CAST(sum(bytes_total_24h) AS DOUBLE) AS bytes FROM windowed GROUP BY 1""")
def snk1(spark, sf_dir):
    data = files.read_engineered(spark, _engineered_path(spark, sf_dir))
    return data.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("unique_resources_24h").alias("resources"),
        F.sum("off_hours_event_count_7d").alias("off_hours"), F.sum("risk_multiplier").alias("risk"),
        F.sum("bytes_total_24h").alias("bytes"),
    )


@query("src5_read_audit_log", "SELECT timestamp, incident_id, previous_status, new_status, analyst, coalesce(remarks, '') AS remarks FROM audit")
def src5(spark, sf_dir):
    path = scratch_path(spark, "audit")
    missing = files.read_audit_log(spark, path)
    files.append_audit(source.audit(source.access_log(spark, sf_dir)), path)
    return missing.unionByName(files.read_audit_log(spark, path)).fillna({"remarks": ""})


@query("snk2_append_audit", "SELECT incident_id, 2 * count(*) AS actions FROM audit GROUP BY 1")
def snk2(spark, sf_dir):
    path = scratch_path(spark, "audit")
    audit = source.audit(source.access_log(spark, sf_dir))
    files.append_audit(audit, path)
    files.append_audit(audit, path)
    return files.read_audit_log(spark, path).groupBy("incident_id").agg(F.count(F.lit(1)).alias("actions"))


@query("src6_lookup_dimensions", """
SELECT geo_location, geo_lat, geo_lon, count(*) AS events, count(DISTINCT resource_category) AS categories,
  count(*) FILTER (WHERE device_os <> 'Windows 12') AS with_agent FROM log GROUP BY 1, 2, 3""")
def src6(spark, sf_dir):
    log = source.access_log(spark, sf_dir).drop("geo_lat", "geo_lon", "user_agent")
    # Fixed tables of at most 52 rows.
    placed = log.join(F.broadcast(files.places(spark)), "geo_location", "left").join(
        F.broadcast(files.user_agents(spark)), "device_os", "left"
    ).join(F.broadcast(files.resources(spark).select("resource_category").distinct()), "resource_category", "left_semi")
    return placed.groupBy("geo_location", "geo_lat", "geo_lon").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("resource_category").alias("categories"),
        F.count("user_agent").alias("with_agent"),
    )


@query("snk3_export_csv", """
SELECT 'entity_profiles' AS name, count(DISTINCT entity_id) AS exported FROM log
UNION ALL SELECT 'events', count(*) FROM log UNION ALL SELECT 'labels', count(*) FROM log""")
def snk3(spark, sf_dir):
    path = scratch_path(spark, "export")
    log = source.access_log(spark, sf_dir)
    files.export_csv(log.select(EVENT_COLUMNS), log.select("event_id", *LABEL_COLUMNS), profiles_of(log), path)
    back = [
        ("entity_profiles", files.read_profiles(spark, f"{path}/entity_profiles")),
        ("events", files.read_events(spark, f"{path}/events")),
        ("labels", files.read_labels(spark, f"{path}/labels")),
    ]
    counts = [df.agg(F.count("entity_id" if n != "labels" else "event_id").alias("exported")).select(
        F.lit(n).alias("name"), "exported") for n, df in back]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_REPORT = ["total_samples", "actual_anomalies", "predicted_anomalies", "tp", "fp", "tn", "fn", "precision", "recall", "f1_score",
           "false_positive_rate", "detection_rate", "roc_auc", "pr_auc", "alerts_triggered", "top_precision", "top_recall"]


_METRIC_LINES = f"""
SELECT metric, format('{{:<24}} {{:.4f}}', metric, value) AS line FROM (
  SELECT unnest({_REPORT}) AS metric, unnest([CAST(n AS DOUBLE), tp + fn, tp + fp, tp, fp, tn, fn,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END,
    CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, roc_auc, pr_auc, k, top_precision, top_recall]) AS value
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE h AND t) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE h AND NOT t) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE NOT h AND NOT t) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE NOT h AND t) AS DOUBLE) AS fn
    FROM (SELECT anomaly_score >= 0.7 AS h, label = 'anomaly' AS t FROM scored) q) c,
  (SELECT CAST(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS DOUBLE) AS roc_auc
    FROM (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM per_score) q) r,
  (SELECT CAST(sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END) / 2.0) / sum(pos) AS DOUBLE) AS pr_auc
    FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM per_score WINDOW w AS (ORDER BY s DESC)) q) p,
  (SELECT CAST(count(*) AS DOUBLE) AS k, count(*) FILTER (WHERE label = 'anomaly') / count(*) AS top_precision,
    count(*) FILTER (WHERE label = 'anomaly') / (SELECT count(*) FROM scored WHERE label = 'anomaly') AS top_recall
    FROM (SELECT label, row_number() OVER (ORDER BY anomaly_score DESC, event_id) AS k, count(*) OVER () AS n FROM scored) q
    WHERE k <= greatest(1, CAST(floor(n * 0.01) AS BIGINT))) b) m"""


def _report_parts(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    scores = source.scored(source.access_log(spark, sf_dir))
    parts = [evaluate.binary_metrics(scores, 0.7), evaluate.roc_auc(scores), evaluate.pr_auc(scores), evaluate.top_budget(scores)]
    metrics = [evaluate.long_metrics(p) for p in parts]
    files.write_metrics(metrics[0].unionByName(metrics[1]).unionByName(metrics[2]).unionByName(metrics[3]), path)
    named = scores.where("label = 'anomaly'")
    return (spark.read.schema("metric string, value double").json(path), evaluate.per_class_report(named, "attack_type", "predicted_attack"),
            evaluate.confusion_matrix(named, "attack_type", "predicted_attack", V.ATTACK_TYPES))


@query("snk6_evaluation_report", _METRIC_LINES)
def snk6(spark, sf_dir):
    return evaluate.report_text(_report_parts(spark, sf_dir)[0])


_COUNTS = ", ".join(f"count(*) FILTER (WHERE predicted_attack = '{a}')" for a in V.ATTACK_TYPES)


@query("snk6_full_report", f"""
SELECT line FROM ({_METRIC_LINES}) a
UNION ALL SELECT format('{{:<24}} {{:.4f}} {{:.4f}} {{:.4f}} {{}}', class, precision::DOUBLE, recall::DOUBLE, f1_score::DOUBLE, support) FROM class_rates
UNION ALL SELECT format('{{:<24}}{" {}" * len(V.ATTACK_TYPES)}', attack_type, {_COUNTS}) FROM scored WHERE label = 'anomaly' GROUP BY attack_type
UNION ALL SELECT '== ' || unnest(['metrics', 'classes', 'confusion']) || ' =='""")
def snk6_full(spark, sf_dir):
    path = scratch_path(spark, "report")
    files.write_text_report(evaluate.full_report(*_report_parts(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("snk6_trained_report")
def snk6_trained(spark, sf_dir):
    """The report of the classifier that is trained here, with its importances."""
    data, _, names, fitted = engineered(spark, sf_dir)
    found = the_classifier(spark, sf_dir)
    held = written(found.predict(data.where(~fitted.cut.is_train() & (F.col("label") == "anomaly"))).select("attack_type", "predicted_attack"), "held-out")
    importances = found.top_features(spark, len(names))
    path = scratch_path(spark, "report")
    metrics = evaluate.long_metrics(evaluate.multiclass_metrics(held, "attack_type", "predicted_attack"))
    files.write_text_report(evaluate.full_report(metrics, evaluate.per_class_report(held, "attack_type", "predicted_attack"),
                                                 evaluate.confusion_matrix(held, "attack_type", "predicted_attack", found.classes), importances), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
