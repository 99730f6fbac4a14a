"""Hand-computed edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenlog.functions import columns, ranking, timeline
from wardenlog.operators import baseline, clean, evaluate, features, forest, incident, risk, scaling, storyline, triage
from wardenlog.schema import EVENT_COLUMNS
from wardenlog.sources import files


def one(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def test_composite_risk_of_known_event(spark):
    row = risk.composite_risk(one(
        spark, anomaly_score=0.95, classifier_confidence=0.98, risk_multiplier=4.0, attack_type="impossible_travel"
    )).first()
    assert row["risk_score"] == 89 and row["risk_level"] == "High"


def test_risk_floor_and_half_even(spark):
    raw = lambda a, c, m, t: one(spark, anomaly_score=a, classifier_confidence=c, risk_multiplier=m, attack_type=t)
    assert risk.composite_risk(raw(0.9, 0.5, 0.0, "lateral_movement")).first()["risk_score"] == 85
    assert risk.composite_risk(raw(0.9, 0.5, 0.0, "insider_drift")).first()["risk_score"] == 54
    assert spark.range(1).select(columns.round_half_even(F.lit(2.5)), columns.round_half_even(F.lit(3.5))).first()[:] == (2, 4)


@pytest.mark.parametrize("text, expected", [
    ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T03:04:05.250001Z", dt.datetime(2024, 1, 2, 3, 4, 5, 250001)),
    ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02T05:04:05+02:00", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("soon", None),
])
def test_times(spark, text, expected):
    assert spark.range(1).select(clean.parse_timestamp(F.lit(text))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    ("['whoami', 'id']", ["whoami", "id"]), ('["a, b"]', ["a, b"]), ("[]", []), ("unknown", []), ("[1, ", []),
    ("{'a': 1}", []), (None, []),
])
def test_command_lists(spark, text, expected):
    df = spark.createDataFrame([(text,)], "command_sequence string")
    row = clean.parse_commands(df).first()
    assert row["command_list"] == expected and row["command_count"] == len(expected)


def test_booleans(spark):
    df = spark.createDataFrame([("True",), ("False",), (None,), ("1",)], "b string")
    assert [r[0] for r in df.select(clean.parse_boolean(F.col("b"))).collect()] == [True, False, False, True]


def test_first_of_many_copies(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("event_id"),
        F.col("id").alias("timestamp"), F.lit("x").alias("other"))
    out = clean.drop_duplicates_first(df)
    assert out.count() == df.select("event_id").distinct().count()
    assert out.where("event_id = 'same'").first()["timestamp"] == 0


def test_single_event_entity_and_zero_deviation(spark):
    stats = spark.createDataFrame(
        [("a", 1, None, None, None), ("b", 3, 0.0, 2.0, None)],
        "entity_id string, event_count long, raw_std_hour double, raw_std_session_duration double, raw_std_bytes double")
    got = {r["entity_id"]: (r["std_hour"], r["std_session_duration"], r["std_bytes"]) for r in baseline.guard_deviations(stats).collect()}
    assert got == {"a": (4.0, 600.0, 10000.0), "b": (1.0, 2.0, 1.0)}


def test_usual_method_tie_is_smallest(spark):
    df = spark.createDataFrame([("e", "token"), ("e", "sso"), ("f", "token")], "entity_id string, auth_method string")
    got = {r[0]: r[1] for r in baseline.primary_auth_method(df).collect()}
    assert got == {"e": "sso", "f": "token"}


def test_keyword_across_two_commands(spark):
    df = spark.createDataFrame([(["net", "user"],), (["ls"],), ([],)], "command_list array<string>")
    assert [r["suspicious_cmd_flag"] for r in features.commands(df).collect()] == [1, 0, 0]


def test_zero_duration_and_cap(spark):
    df = spark.createDataFrame([(10, 0), (10_000_000, 1), (10, 4)], "bytes_transferred long, session_duration long")
    assert [r["bytes_per_second"] for r in features.transfer_rate(df).collect()] == [0.0, 1e6, 2.5]


def test_cut_with_tied_times(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"e{i}", t) for i in range(10)], "event_id string, timestamp timestamp_ntz")
    train, test = clean.temporal_split(df)
    assert sorted(r["event_id"] for r in train.collect()) == [f"e{i}" for i in range(6)]
    assert test.count() == 4


def test_percentiles_are_interpolated(spark):
    values = np.random.default_rng(3).lognormal(0, 3, 30_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = ranking.percentiles(df, F.col("x"), [0.99, 0.5, 0.0, 1.0])
    assert got == pytest.approx(np.percentile(values, [99, 50, 0, 100]).tolist(), rel=1e-12)


def test_encoding_of_unknown_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "protocol string")
    vocabulary = clean.fit_categories(df.where("protocol <> 'c'"), ["protocol"])
    got = {r["protocol_raw"]: r["protocol_encoded"] for r in clean.encode_categories(df, vocabulary, ["protocol"]).collect()}
    assert got == {"a": 0, "b": 1, "c": -1}


def test_encoding_over_several_ranges(spark):
    rows = [(f"v{i:03}", None if i % 7 == 0 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "protocol string, auth_method string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        vocabulary = clean.fit_categories(df.where("protocol < 'v250'"), ["protocol", "auth_method"])
        codes = {(r["column"], r["value"]): r["code"] for r in vocabulary.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert codes == {("auth_method", "x"): 0} | {("protocol", f"v{i:03}"): i for i in range(250)}
    got = {r["protocol_raw"]: (r["protocol_encoded"], r["auth_method_encoded"]) for r in clean.encode_categories(df, vocabulary, ["protocol", "auth_method"]).collect()}
    # Unknown and null values have no code.
    assert got == {f"v{i:03}": (i if i < 250 else -1, -1 if i % 7 == 0 else 0) for i in range(300)}


def test_reopened_incident_keeps_normal_type(spark):
    t = dt.datetime(2024, 1, 1)
    audit = spark.createDataFrame([
        (t, "e1", "", "RESOLVED", "a", ""), (t + dt.timedelta(hours=1), "e1", "", "CONFIRMED_THREAT", "b", " again "),
    ], "timestamp timestamp_ntz, incident_id string, previous_status string, new_status string, analyst string, remarks string")
    events = spark.createDataFrame(
        [("e1", "anomaly", "brute_force"), ("e2", "anomaly", "brute_force")], "event_id string, label string, attack_type string")
    got = {r["event_id"]: r for r in triage.apply_actions(events, audit).collect()}
    assert (got["e1"]["label"], got["e1"]["attack_type"], got["e1"]["status"]) == ("anomaly", "normal", "CONFIRMED_THREAT")
    assert got["e1"]["analyst_feedback"] == "again" and got["e2"]["status"] == "LIVE_THREAT"


def test_empty_storyline(spark):
    df = spark.createDataFrame([], "event_id string, entity_id string, timestamp timestamp_ntz, label string, attack_type string")
    row = storyline.summary_of(df, "nobody").first()
    assert row["total_stages"] == 0 and row["attack_narrative"] == "No activity recorded for entity."


def test_texts_without_a_date_are_no_times(spark):
    df = spark.createDataFrame([("12:30:00",), ("2024-01-02T03:04:05Z",), ("x",), (None,), (" 2024-1-2",)], "t string")
    got = [str(r[0]) for r in df.select(clean.parse_timestamp(F.col("t"))).collect()]
    assert got == ["None", "2024-01-02 03:04:05", "None", "None", "2024-01-02 00:00:00"]


@pytest.mark.parametrize("values, want", [([], [None]), ([5.0], [5.0]), ([2.0] * 5000, [2.0]), ([1.0, float("nan"), 3.0], [2.0])])
def test_percentiles_of_odd_columns(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ranking.percentiles(df.where(~F.isnan("x")), F.col("x"), [0.5])
    assert [None if g is None or g != g else g for g in got] == want


def test_audit_remarks_with_line_breaks(spark, tmp_path):
    path = str(tmp_path / "audit")
    t = dt.datetime(2024, 1, 1)
    rows = [(t, "e1", "LIVE_THREAT", "RESOLVED", "a", 'two\nlines, "quoted"'), (t, "e2", "", "RESOLVED", "b", "")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, incident_id string, previous_status string, new_status string, analyst string, remarks string")
    files.append_audit(df, path)
    got = {r["incident_id"]: r["remarks"] for r in files.read_audit_log(spark, path).collect()}
    assert got["e1"] == 'two\nlines, "quoted"' and not got["e2"]


def csv_line(**values):
    return ",".join('"' + values.get(c, "").replace('"', '""') + '"' for c in EVENT_COLUMNS)


def test_bad_records_beside_good_ones(spark, tmp_path):
    good = csv_line(event_id="e1", timestamp="2024-01-01", user_agent='two\nlines, "quoted"')
    (tmp_path / "log.csv").write_text("\n".join([",".join(EVENT_COLUMNS), good, "e2,2024-01-02", csv_line(event_id="e3") + ",more", good]) + "\n")
    accepted, rejected, counts = files.split_records(files.read_events(spark, str(tmp_path), keep_bad=True))
    assert counts == {"accepted": 2, "rejected": 2} and accepted.columns == EVENT_COLUMNS
    assert [r["user_agent"] for r in accepted.collect()] == ['two\nlines, "quoted"'] * 2
    assert sorted(r["record"] for r in rejected.collect()) == sorted(["e2,2024-01-02", csv_line(event_id="e3") + ",more"])
    # Without the column, a short record is filled with nulls.
    assert files.read_events(spark, str(tmp_path)).where("event_id = 'e2' AND entity_id IS NULL").count() == 1


def test_log_without_bad_records(spark, tmp_path):
    (tmp_path / "log.csv").write_text(",".join(EVENT_COLUMNS) + "\n")
    accepted, rejected, counts = files.split_records(files.read_events(spark, str(tmp_path), keep_bad=True))
    assert accepted.count() == rejected.count() == 0 and set(counts.values()) == {0}


AUDIT_FIELDS = "timestamp timestamp_ntz, incident_id string, previous_status string, new_status string, analyst string, remarks string"


def test_remarks_of_one_incident_stay_in_bounded_rows(spark):
    # A hundred thousand remarks of one incident within a day, cut into slices of time as well.
    audit = spark.range(100_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 80_000).cast("timestamp_ntz").alias("timestamp"), F.lit("e1").alias("incident_id"),
        F.lit("").alias("previous_status"), F.lit("RESOLVED").alias("new_status"), F.lit("a").alias("analyst"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("remarks"))
    hot = timeline.find_hot_keys(audit.withColumn("event_date", F.to_date("timestamp")), ["incident_id", "event_date"], max_rows=20_000)
    assert hot
    chunks = triage.remark_chunks(audit, 1000, hot).orderBy("event_date", "chunk").collect()
    assert len(chunks) == 100 and {r["remarks"] for r in chunks} == {1000}
    assert [x for r in chunks for x in r["remark_text"].split(" | ")] == [
        f"r{i}" for i in sorted(range(100_000), key=lambda i: (i % 80_000, f"r{i}"))]


def test_snapshots_merge_in_any_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=i), f"e{i % 2}", "", s, f"a{i}", "") for i, s in enumerate(
        ["RESOLVED", "CONFIRMED_THREAT", "CONFIRMED_THREAT", "UNDER_INVESTIGATION", "UNDER_INVESTIGATION"])]
    audit = spark.createDataFrame(rows, AUDIT_FIELDS)
    whole = sorted(triage.snapshot(audit).collect())
    old, new = (triage.snapshot(audit.where(c)) for c in ("analyst < 'a2'", "analyst >= 'a2'"))
    assert sorted(triage.merge_snapshots(old, new).collect()) == sorted(triage.merge_snapshots(new, old).collect()) == whole
    assert triage.merge_snapshots(old.limit(0), new.limit(0)).count() == 0


def test_moments_of_days_merge(spark):
    rows = [("k", f"2024-01-0{1 + i % 3} 0{i % 8}:00:00", None if i == 4 else 10 ** 9 + i, i) for i in range(9)] + [
        ("one", "2024-01-01 05:00:00", 7, 7), (None, "2024-01-02 05:00:00", 3, 3)]
    log = spark.createDataFrame(rows, "entity_id string, timestamp string, session_duration bigint, bytes_transferred bigint").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))
    round_ = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = round_(baseline.numeric_baselines(log))
    assert round_(baseline.merge_moments(baseline.daily_moments(log))) == want
    parts = [baseline.daily_moments(log.where(f"bytes_transferred % 2 = {k}")) for k in (0, 1)]
    assert round_(baseline.merge_moments(parts[0].unionByName(parts[1]))) == want
    assert baseline.merge_moments(parts[0].limit(0)).count() == 0


def test_timeline_of_one_incident_builds_no_other(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"e{i}", t + dt.timedelta(minutes=i), f"u{i % 50}", "anomaly" if i % 7 == 0 else "normal") for i in range(500)]
    log = spark.createDataFrame(rows, "event_id string, timestamp timestamp_ntz, entity_id string, label string").withColumns(
        {c: F.lit("x") for c in ("attack_type", "action_type", "geo_location", "device_fingerprint", "resource_accessed", "auth_status", "resource_category")}
        | {"bytes_transferred": F.lit(1).cast("bigint")})
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    got = incident.timeline_of(log, "e105")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(f"e{i}" for i in range(500) if i % 50 == 5)
    assert {r["incident_id"] for r in got.collect()} == {"e105"}
    # e106 is no anomaly; the id of an incident is part of what the scan filters by.
    assert incident.timeline_of(log, "e106").count() == incident.timeline_of(log, "none").count() == 0
    assert "EqualTo(event_id,e105)" in got._jdf.queryExecution().toString()


def test_statistics_of_the_pass_that_cleans(spark):
    rows = [(f"e{i % 70}", f"2024-01-01 00:00:{i % 60:02}", None if i % 10 == 0 else "sales", "95" if i % 7 == 0 else "1") for i in range(100)]
    raw = spark.createDataFrame(rows, "event_id string, timestamp string, department string, geo_lat string")
    raw = raw.withColumns({c: F.lit("1" if c in clean.NUMERIC_COLUMNS else "v") for c in EVENT_COLUMNS if c not in raw.columns})
    cleaned, counts = clean.clean_with_statistics(raw)
    want = clean.clean(raw)
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(cleaned) == key(want) and counts["final_rows"] == want.count()
    assert counts["rows_loaded"] == 100 and counts["duplicates_removed"] == 30 and counts["invalid_removed"] == 70 - want.count()
    assert clean.cleaning_statistics(raw).first().asDict() == counts
    empty = clean.clean_with_statistics(raw.limit(0))[1]
    assert set(empty.values()) == {0}


def test_bursts_are_cut_into_even_slices(spark):
    # Nearly all rows of a hot key fall into one minute of a month.
    rows = [("k", i * 86_400_000_000 if i < 30 else 10 * 86_400_000_000 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "entity_id string, us bigint").select(
        "entity_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"))
    hot = timeline.find_hot_keys(df, "entity_id", max_rows=1000)
    sliced, _ = timeline._slice(df.withColumn("_us", columns.micros("timestamp")), "_us", hot)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) >= 6 and max(sizes) <= 2000


def test_missing_audit_log_is_empty(spark, tmp_path):
    assert files.read_audit_log(spark, str(tmp_path / "none")).count() == 0


def test_constant_scores_normalise_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "s double")
    assert [r["n"] for r in scaling.normalise(df, "s", "n").collect()] == [0.0, 0.0]


def test_auc_of_tied_and_perfect_scores(spark):
    df = spark.createDataFrame([("anomaly", 0.5), ("normal", 0.5)], "label string, anomaly_score double")
    assert evaluate.roc_auc(df).first()[0] == 0.5
    perfect = spark.createDataFrame([("anomaly", 0.9), ("normal", 0.1)], "label string, anomaly_score double")
    assert evaluate.roc_auc(perfect).first()[0] == 1.0 and evaluate.pr_auc(perfect).first()[0] == 1.0


def test_forest_separates_planted_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{i}", rng.normal(0, 1, 3).tolist()) for i in range(600)] + [(f"out{i}", [9.0, -9.0, 9.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id string, x array<double>")
    scored = forest.fit_forest(df, F.col("x"), trees=30).score(df, F.col("x")).toPandas()
    median = scored["isolation_raw"].median()
    planted = scored[scored["event_id"].str.startswith("out")]["isolation_raw"]
    assert (planted > median).all() and planted.min() > scored["isolation_raw"].quantile(0.95)
    assert scored["isolation_raw"].between(0, 1).all()


def test_average_path():
    assert forest.average_path(1) == 0.0 and forest.average_path(2) == 1.0
    assert forest.average_path(256) == pytest.approx(10.244, abs=1e-2) and not math.isnan(forest.average_path(3))
