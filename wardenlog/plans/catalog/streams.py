"""Streams over the given events, drained to the end and returned as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import features
from ...schema import EVENT_COLUMNS, LABEL_COLUMNS
from ...scratch import scratch_path
from ...sources import access_log as source
from ...sources import files
from ...streaming import keyed, streams
from .. import features as plan
from .models import alerting, engineered, the_classifier, the_detector
from . import cleaning  # noqa: F401  (its views are used here)
from .files import _GOOD, broken_records
from .registry import VIEWS, dirty_of, log_of, query, rounded

VIEWS["typed_all"] = VIEWS["typed"].replace("FROM firsts", "FROM dirty")
VIEWS["filled_all"] = VIEWS["filled"].replace("FROM typed", "FROM typed_all")
VIEWS["valid_all"] = VIEWS["valid"].replace("FROM filled", "FROM filled_all")


def _dirty_stream(spark, sf_dir):
    path = scratch_path(spark, "stream-in")
    dirty_of(spark, sf_dir).write.options(**files.CSV).csv(path)
    return streams.read_event_stream(spark, path)


def _log_stream(spark, sf_dir):
    path = scratch_path(spark, "stream-in")
    source.access_log(spark, sf_dir).write.parquet(path)
    return streams.read_event_stream(spark, path, "parquet")


def _drain(stream):
    spark = stream.sparkSession
    path = scratch_path(spark, "stream-out")
    streams.run_to_table(stream, path, scratch_path(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(path)


@query("t1_clean_stream", "SELECT event_id, timestamp, geo_lat, bytes_transferred, is_vpn FROM valid_all")
def t1(spark, sf_dir):
    return _drain(streams.clean_stream(_dirty_stream(spark, sf_dir)).select(
        "event_id", "timestamp", "geo_lat", "bytes_transferred", "is_vpn"))


def _broken_stream(spark, sf_dir):
    path = broken_records(spark, sf_dir, [*EVENT_COLUMNS, *LABEL_COLUMNS])
    return streams.read_event_stream(spark, path, keep_bad=True, header=False)


@query("t1_accepted_records", f"SELECT event_id, timestamp, bytes_transferred, user_agent FROM valid_all WHERE {_GOOD}")
def t1_accepted(spark, sf_dir):
    return _drain(streams.clean_stream(streams.accepted_records(_broken_stream(spark, sf_dir))).select(
        "event_id", "timestamp", "bytes_transferred", "user_agent"))


@query("t1_rejected_records", "SELECT event_id, too_long FROM broken")
def t1_rejected(spark, sf_dir):
    rejected = streams.rejected_records(_broken_stream(spark, sf_dir))
    return _drain(rejected.select(F.substring_index("record", ",", 1).alias("event_id"), F.endswith("record", F.lit(",extra")).alias("too_long")))


@query("t2_duplicates", "SELECT DISTINCT event_id, timestamp FROM valid_all")
def t2(spark, sf_dir):
    return _drain(streams.drop_duplicates_stream(streams.clean_stream(_dirty_stream(spark, sf_dir)).select("event_id", "timestamp")))


_Z = ["hour_zscore", "session_duration_zscore", "bytes_zscore"]


@query("t3_baseline_features", "SELECT event_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in features.NOVELTY_COLUMNS)
       + ", " + ", ".join(f"round({z}, 6) AS {z}" for z in _Z) + " FROM featured")
def t3(spark, sf_dir):
    log = log_of(spark, sf_dir)
    fitted = plan.fit(log)
    out = scratch_path(spark, "stream-out")

    def write(batch, batch_id):
        rows = streams.baseline_features(batch, fitted.baselines, fitted.known)
        rows.select("event_id", *features.NOVELTY_COLUMNS, *_Z).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streams.for_each_batch(_log_stream(spark, sf_dir), write, scratch_path(spark, "stream-state"))
    return rounded(spark.read.parquet(out).drop("batch"), *_Z)


@query("t4_history_features", """
SELECT event_id, minutes_since_last, round(geo_velocity_kmh, 6) AS geo_velocity_kmh,
  CAST(failed_auth_count_1h AS BIGINT) AS failed_auth_count_1h, CAST(off_hours_event_count_7d AS BIGINT) AS off_hours_event_count_7d,
  CAST(bytes_total_24h AS DOUBLE) AS bytes_total_24h, unique_resources_24h, unique_geos_24h, unique_entities_per_ip_1h FROM windowed""")
def t4(spark, sf_dir):
    log = source.access_log(spark, sf_dir)
    inbox, state = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-state")
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    step = streams.HistoryFeatures(state, out)
    # Ordered replay in three parts; each is drained before the next arrives.
    days = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-10")]
    first, last = F.lit("1970-01-01"), F.lit("2100-01-01")
    for i, (lo, hi) in enumerate(days):
        since = first if i == 0 else F.lit(lo)
        until = last if i == len(days) - 1 else F.lit(hi)
        day = F.to_date("timestamp")
        log.where((day >= since.cast("date")) & (day < until.cast("date"))).write.mode("append").parquet(inbox)
        streams.for_each_batch(streams.read_event_stream(spark, inbox, "parquet"), step, checkpoint)
    return rounded(spark.read.parquet(out), "geo_velocity_kmh").select(
        "event_id", "minutes_since_last", "geo_velocity_kmh", "failed_auth_count_1h", "off_hours_event_count_7d",
        "bytes_total_24h", "unique_resources_24h", "unique_geos_24h", "unique_entities_per_ip_1h",
    )


@query("t4_keyed_history", """
SELECT event_id, minutes_since_last, round(geo_velocity_kmh, 6) AS geo_velocity_kmh,
  CAST(failed_auth_count_1h AS BIGINT) AS failed_auth_count_1h, CAST(failed_auth_count_24h AS BIGINT) AS failed_auth_count_24h,
  CAST(off_hours_event_count_7d AS BIGINT) AS off_hours_event_count_7d, CAST(bytes_total_24h AS BIGINT) AS bytes_total_24h,
  unique_resources_1h, unique_resources_24h, unique_geos_24h, unique_entities_per_ip_1h FROM windowed""")
def t4_keyed(spark, sf_dir):
    """Replay in parts, of which each holds events of the day before its own, late, and others a second time."""
    log = source.access_log(spark, sf_dir)
    inbox, n, day = scratch_path(spark, "stream-in"), F.substring("event_id", 5, 20).cast("bigint"), F.to_date("timestamp")
    cuts = [F.lit(d).cast("date") for d in ("1970-01-01", "2024-01-11", "2024-01-21", "2200-01-01")]
    # An event long after all others moves the watermark past them; it waits for ever itself.
    end = log.limit(1).withColumns({"timestamp": F.lit("2100-01-01").cast("timestamp_ntz"), "event_id": F.lit("evt_0"), "entity_id": F.lit("")})
    both = None
    for i in range(5):
        if i < 3:
            late = (day == cuts[i + 1] - F.expr("INTERVAL 1 DAY")) & (n % 17 == 0)
            part = log.where((day >= cuts[i]) & (day < cuts[i + 1]) & (F.lit(i == 2) | ~late))
            if i:
                yesterday = log.where(day == cuts[i] - F.expr("INTERVAL 1 DAY"))
                part = part.unionByName(yesterday.where((n % 17 == 0) | (n % 23 == 0)))
        else:
            part = end
        part.write.mode("append").parquet(inbox)
        if both is None:
            stream = streams.read_event_stream(spark, inbox, "parquet")
            both = [(kind(stream, "2 days"), scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state"))
                    for kind in (keyed.entity_history, keyed.address_history)]
        for made, out, state in both:
            streams.run_to_table(made, out, state)
    own, address = (spark.read.schema(made.schema).parquet(out) for made, out, _ in both)
    return rounded(own.join(address, "event_id"), "geo_velocity_kmh").select(
        "event_id", "minutes_since_last", "geo_velocity_kmh", "failed_auth_count_1h", "failed_auth_count_24h", "off_hours_event_count_7d",
        "bytes_total_24h", "unique_resources_1h", "unique_resources_24h", "unique_geos_24h", "unique_entities_per_ip_1h")


@query("t5_hourly_trend", """
SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS hour, count(*) AS incidents FROM log WHERE label = 'anomaly' GROUP BY 1""")
def t5_trend(spark, sf_dir):
    path = scratch_path(spark, "stream-out")
    streams.run_updates(streams.hourly_trend(_log_stream(spark, sf_dir)), path, scratch_path(spark, "stream-state"))
    return streams.latest_updates(spark, path, ["hour"], "incidents").where("incidents > 0")


@query("t5_sliding_failures", """
SELECT w AS window_start, entity_id, count(*) AS failures
FROM (SELECT *, unnest(generate_series(0, 11)) AS i FROM log WHERE failed = 1) l,
  LATERAL (SELECT time_bucket(INTERVAL 5 MINUTES, timestamp) - i * INTERVAL 5 MINUTES AS w) b
GROUP BY 1, 2""")
def t5_sliding(spark, sf_dir):
    path = scratch_path(spark, "stream-out")
    streams.run_updates(streams.sliding_failures(_log_stream(spark, sf_dir)), path, scratch_path(spark, "stream-state"))
    return streams.latest_updates(spark, path, ["window_start", "entity_id"], "failures").where("failures > 0")


@query("t6_stream_alerts")
def t6(spark, sf_dir):
    _, _, _, fitted = engineered(spark, sf_dir)
    path, state, made = (scratch_path(spark, f"stream-{x}") for x in ("out", "history", "features"))
    history = streams.HistoryFeatures(state, made)

    def prepare(batch, batch_id):
        history(batch, batch_id)
        own = spark.read.parquet(f"{made}/batch={batch_id}")
        return streams.engineered_batch(streams.clean.parse_commands(batch), own, fitted.baselines, fitted.known, fitted.vocabulary)

    writer = streams.AlertWriter(the_detector(spark, sf_dir), the_classifier(spark, sf_dir), prepare, path)
    streams.for_each_batch(_log_stream(spark, sf_dir), writer, scratch_path(spark, "stream-state"))
    return rounded(spark.read.parquet(path).drop("batch"), "anomaly_score", "classifier_confidence")


@query("t6_same_as_batch", "SELECT CAST(0 AS BIGINT) AS different")
def t6_same(spark, sf_dir):
    """Events alerted on by the stream or by the batch job alone."""
    live = t6(spark, sf_dir).select("event_id", F.lit(1).alias("live"))
    batch = alerting(spark, sf_dir).select("event_id", F.lit(1).alias("batch"))
    return live.join(batch, "event_id", "full").agg(F.count_if(F.col("live").isNull() | F.col("batch").isNull()).alias("different"))
