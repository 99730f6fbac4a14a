"""Cleaning, typing, splitting and encoding of the raw log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F, types as T

from ..functions.columns import micros
from ..functions.ranking import string_at_rank, value_at_rank
from ..schema import CATEGORICAL_COLUMNS, LABEL_COLUMNS, META_COLUMNS
from ..scratch import written

NUMERIC_COLUMNS = ["session_duration", "bytes_transferred", "geo_lat", "geo_lon"]
ZERO_FILLED = ["session_duration", "bytes_transferred", "geo_lat", "geo_lon"]
UNKNOWN_FILLED = [
    "entity_type", "entity_role", "department", "source_ip", "geo_location", "resource_accessed",
    "resource_category", "action_type", "auth_method", "auth_status", "protocol",
    "device_fingerprint", "device_os", "user_agent", "command_sequence",
]


def repeated_keys(df: DataFrame, key: str = "event_id", counted: Observation | None = None) -> DataFrame:
    """Keys of more than one row (column ``_key``), written: one pass over the key column alone. ``counted`` gets the numbers of rows and keys."""
    keys = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    if counted is not None:
        keys = keys.observe(counted, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
    return written(keys.where("_n > 1").select("_key"), "repeated-keys")


def drop_duplicates_first(df: DataFrame, key: str = "event_id", first_by: str | None = "timestamp", repeated: DataFrame | None = None) -> DataFrame:
    """One row per key: the smallest by ``first_by``, then by all columns in order.

    Keys are counted first, by the key column alone. Rows of a unique key, as nearly all are, pass as they are; only
    those of repeated keys are aggregated, where copies meet in the map tasks, so that a key with very many copies
    sends one row per task through the shuffle. A log without repeated keys is only read once more.
    """
    others = [c for c in df.columns if c != key]
    if first_by:
        others = [first_by] + [c for c in others if c != first_by]
    repeated = repeated_keys(df, key) if repeated is None else repeated
    if repeated.isEmpty():
        return df
    same = F.col(key).eqNullSafe(F.col("_key"))
    copies = df.join(repeated, same, "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("_first"))
    return df.join(repeated, same, "left_anti").unionByName(copies.select(key, "_first.*").select(df.columns))


def attach_labels(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Left equi-join on the event id; labels are reduced to one per event first."""
    return events.join(drop_duplicates_first(labels, first_by=None), "event_id", "left")


def parse_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "t"), F.lit(False))


def parse_timestamp(c: Column) -> Column:
    """UTC wall-clock time of an ISO text, with or without fraction, offset or ``Z``; null if malformed.

    Spark's own text cast accepts all of these forms; ``try_cast`` turns the rest into null. A text without a date is
    malformed: the cast would add the current one.
    """
    dated = c.cast("string").rlike(r"^\s*\d{4,}-\d{1,2}-\d{1,2}")
    return F.when(dated, c.try_cast("timestamp").cast("timestamp_ntz"))


def fix_types(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "timestamp": parse_timestamp(F.col("timestamp")),
        "session_duration": F.col("session_duration").try_cast("double").try_cast("bigint"),
        "bytes_transferred": F.col("bytes_transferred").try_cast("double").try_cast("bigint"),
        "geo_lat": F.col("geo_lat").try_cast("double"),
        "geo_lon": F.col("geo_lon").try_cast("double"),
        "is_vpn": parse_boolean(F.col("is_vpn")),
    })


def missing_count(df: DataFrame) -> Column:
    """Number of fields of a typed row that filling will replace (labels are not counted)."""
    fields = [(c, t) for c, t in df.dtypes if c in ZERO_FILLED + UNKNOWN_FILLED]
    absent = [F.col(c).isNull() | F.isnan(c) if t == "double" else F.col(c).isNull() for c, t in fields]
    return sum((F.when(a, 1).otherwise(0) for a in absent), F.lit(0)).cast("bigint")


def fill_missing(df: DataFrame) -> DataFrame:
    fill: dict[str, object] = {c: 0 for c in ZERO_FILLED if c in df.columns}
    fill |= {c: "unknown" for c in UNKNOWN_FILLED if c in df.columns}
    fill |= {c: "normal" for c in LABEL_COLUMNS if c in df.columns}
    return df.fillna(fill)


def is_valid() -> Column:
    return (
        F.col("timestamp").isNotNull()
        & F.col("geo_lat").between(-90, 90)
        & F.col("geo_lon").between(-180, 180)
        & (F.col("session_duration") >= 0)
        & (F.col("bytes_transferred") >= 0)
    )


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def parse_commands(df: DataFrame) -> DataFrame:
    """``command_sequence`` list literal to an array; anything that is not a list becomes an empty one."""
    parsed = F.from_json(
        "command_sequence", T.ArrayType(T.StringType()), {"allowBackslashEscapingAnyCharacter": "true"}
    )
    commands = F.coalesce(parsed, F.array().cast("array<string>"))
    return df.withColumn("command_list", commands).withColumn(
        "command_count", F.size("command_list").cast("bigint")
    )


def clean(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Raw events (and labels) to typed, filled, valid rows with parsed commands, in no particular order."""
    df = drop_duplicates_first(events)
    if labels is not None:
        df = attach_labels(df, labels)
    return df.transform(fix_types).transform(fill_missing).transform(drop_invalid).transform(parse_commands)


def _typed_with_statistics(events: DataFrame) -> tuple[DataFrame, Observation, Observation]:
    """Typed, filled rows with what is counted on the way: rows and keys of the log; fields filled and rows that are invalid."""
    loaded, passed = Observation(), Observation()
    typed = drop_duplicates_first(events, repeated=repeated_keys(events, counted=loaded)).transform(fix_types)
    flagged = fill_missing(typed.withColumn("_missing", missing_count(typed)))
    bad = F.coalesce(F.sum(F.when(is_valid(), 0).otherwise(1)), F.lit(0)).cast("bigint")
    return flagged.observe(passed, F.coalesce(F.sum("_missing"), F.lit(0)).alias("filled"), bad.alias("bad"), F.count(F.lit(1)).alias("keys")).drop("_missing"), loaded, passed


def _counts(loaded: Observation, passed: Observation) -> dict[str, int]:
    rows, seen = loaded.get["rows"], passed.get
    return {"rows_loaded": rows, "duplicates_removed": rows - seen["keys"], "missing_filled": seen["filled"],
            "invalid_removed": seen["bad"], "final_rows": seen["keys"] - seen["bad"]}


def clean_with_statistics(events: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Cleaned rows as a written table, and the counts of the very passes that made it."""
    rows, loaded, passed = _typed_with_statistics(events)
    made = written(rows.transform(drop_invalid).transform(parse_commands), "clean-log")
    return made, _counts(loaded, passed)


def cleaning_statistics(events: DataFrame) -> DataFrame:
    """One row of counts, for a log whose cleaned rows are not wanted."""
    rows, loaded, passed = _typed_with_statistics(events)
    rows.select("timestamp").write.format("noop").mode("overwrite").save()
    counts = _counts(loaded, passed)
    return events.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{c} bigint" for c in counts))


def chronological(df: DataFrame) -> DataFrame:
    """Global time order; a range-partitioned sort, for sinks that need it."""
    return df.orderBy("timestamp", "event_id")


# --- Temporal split ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """Last (time, event) of the training part."""

    micros: int | None
    event_id: str | None

    def is_train(self) -> Column:
        if self.micros is None:
            return F.lit(False)
        at = F.timestamp_micros(F.lit(self.micros)).cast("timestamp_ntz")
        t = F.col("timestamp").cast("timestamp_ntz")
        tie = F.lit(True) if self.event_id is None else F.col("event_id") <= F.lit(self.event_id)
        return (t < at) | ((t == at) & tie)


def find_cut(df: DataFrame, ratio: float = 0.60) -> Cut:
    """Cut after the first ``int(n * ratio)`` rows in (time, event_id) order, found by counting."""
    us = df.select("event_id", micros("timestamp").alias("_us"))
    n, lo, hi = us.agg(F.count("_us"), F.min("_us"), F.max("_us")).first()
    n_train = int(n * ratio)
    if n_train == 0:
        return Cut(None, None)
    at, before, tied = value_at_rank(us, F.col("_us"), [n_train - 1], lo, hi)[n_train - 1]
    if before + tied == n_train:
        return Cut(int(at), None)
    last = string_at_rank(us.where(F.col("_us") == at), "event_id", n_train - 1 - before, tied)
    return Cut(int(at), last)


def temporal_split(df: DataFrame, ratio: float = 0.60, cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    cut = cut or find_cut(df, ratio)
    return df.where(cut.is_train()), df.where(~cut.is_train())


# --- Categorical encoding ---------------------------------------------------------------------------


def fit_categories(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Vocabulary table (column, value, code): code is the position among the column's sorted values.

    Distinct values are written in ranges; each is numbered by itself and carries on from the ranges before it.
    """
    columns = columns or [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    # Distinct combinations first: they combine in the map tasks and are few before they are unpivoted.
    combos = df.select(*columns).distinct()
    long = combos.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_v")).select("_v.*").where(F.col("value").isNotNull()).distinct()
    ranges = written(long.repartitionByRange("column", "value").withColumn("_range", F.spark_partition_id()), "values")
    before = W.partitionBy("column").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = ranges.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    here = F.row_number().over(W.partitionBy("column", "_range").orderBy("value"))
    return ranges.withColumn("_k", here).join(carry, ["column", "_range"]).select(
        "column", "value", (F.col("_k") + F.col("_c") - 1).cast("bigint").alias("code"))


def encode_categories(df: DataFrame, vocabulary: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``<c>_raw`` and ``<c>_encoded`` (unknown value: -1).

    The distinct combinations of the columns are encoded, and the log is joined with them once.
    """
    columns = columns or [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    out = df.withColumns({f"{c}_raw": F.col(c).cast("string") for c in columns})
    of = [f"_of_{c}" for c in columns]
    combos = out.select([F.col(f"{c}_raw").alias(f"_of_{c}") for c in columns]).distinct()
    # In long form, all columns meet the vocabulary in one join; the codes come back as one row for each combination.
    asked = combos.select(*of, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_of_{c}").alias("value")) for c in columns])).alias("_v"))
    coded = asked.select(*of, "_v.*").join(vocabulary.select("column", "value", "code"), ["column", "value"], "left")
    combos = coded.groupBy(*of).agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("code"))), F.lit(-1)).cast("bigint").alias(f"{c}_encoded") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"{c}_raw").eqNullSafe(F.col(f"_of_{c}"))
    return out.join(combos, same, "left").drop(*of)


def model_features(df: DataFrame) -> list[str]:
    """Numeric columns of the engineered frame without labels, metadata and raw copies."""
    excluded = set(LABEL_COLUMNS) | set(META_COLUMNS)
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded and not f.name.endswith("_raw")
    ]


def align_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """The model's columns in the model's order; absent or null values are 0.0."""
    present = set(df.columns)
    features = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c) for c in names
    ]
    return df.select(*(keep or []), *features)


def order_columns(df: DataFrame) -> DataFrame:
    """Metadata, raw copies, features, labels."""
    meta = [c for c in META_COLUMNS if c in df.columns]
    raw = [c for c in df.columns if c.endswith("_raw")]
    labels = [c for c in LABEL_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in {*meta, *raw, *labels}]
    return df.select(*meta, *raw, *rest, *labels)


def with_triage_columns(df: DataFrame) -> DataFrame:
    """Persistence columns, where absent."""
    defaults = {
        "status": F.when(F.col("label") == "anomaly", "LIVE_THREAT").otherwise("BENIGN"),
        "analyst_feedback": F.lit(""),
        "last_updated": F.lit(""),
        "updated_by": F.lit(""),
    }
    return df.withColumns({c: e for c, e in defaults.items() if c not in df.columns})
