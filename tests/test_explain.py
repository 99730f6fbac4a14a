from pyspark.sql import functions as F

from wardenlog.operators import explain


def test_evidence_takes_counts_that_a_classifier_made_doubles(spark):
    row = spark.range(1).select(
        F.lit(500.0).alias("geo_velocity_kmh"), F.lit(7.0).alias("failed_auth_count_1h"), F.lit(9.0).alias("unique_entities_per_ip_1h"),
        F.lit(0.0).alias("device_novelty"), F.lit(0.0).alias("is_off_hours"), F.lit(0.0).alias("category_novelty"), F.lit(0.0).alias("suspicious_cmd_flag"),
        F.lit("fp-1").alias("device_fingerprint"), F.lit("10.0.0.1").alias("source_ip"), F.lit("email").alias("resource_category"), F.lit("[]").alias("command_sequence"))
    found = explain.evidence(row).first()
    assert found["behavioral_deviations"][1:] == [
        "High authentication failure rate: 7 failed attempts in past hour",
        "Source IP 10.0.0.1 attempted logins across 9 distinct accounts within 1 hour"]
    assert found["evidence"]["failed_auth_count_1h"] == 7 and found["evidence"]["multi_account_ip_spray"] == 9
