"""Analyst triage. The audit trail is append-only; current states are derived from it by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.columns import lookup
from ..functions.timeline import HotKeys, with_position, with_previous


def record_actions(
    requests: DataFrame, events: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Complete requested actions (timestamp, incident_id, new_status, analyst, remarks) to audit rows.

    ``previous_status`` is the incident's previous action, or its state before any action. Requests for unknown
    incidents are ignored.
    """
    initial = F.when(F.col("label") == "anomaly", "LIVE_THREAT").otherwise("BENIGN")
    known = events.select(F.col("event_id").alias("incident_id"), initial.alias("_initial"))
    ordered = with_previous(requests, "incident_id", {"new_status": "_previous"}, tie="new_status", hot=hot)
    return ordered.join(known, "incident_id").select(
        "timestamp", "incident_id", F.coalesce("_previous", "_initial").alias("previous_status"),
        "new_status", "analyst", "remarks",
    )


def latest_actions(audit: DataFrame) -> DataFrame:
    """Latest action per incident."""
    last = F.max(F.struct("timestamp", "new_status", "analyst"))
    return audit.groupBy("incident_id").agg(last.alias("_l")).select(
        "incident_id", F.col("_l.new_status").alias("status"),
        F.col("_l.timestamp").alias("last_updated"), F.col("_l.analyst").alias("updated_by"),
    )


def feedback_texts(audit: DataFrame) -> DataFrame:
    """Non-blank remarks per incident in time order, joined with `` | `` and trimmed.

    Joined per day first, so one task orders a day's remarks and then the days.
    """
    remarks = audit.where(F.coalesce(F.col("remarks"), F.lit("")) != "")
    daily = remarks.groupBy("incident_id", F.to_date("timestamp").alias("_day")).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "new_status", "remarks"))).alias("_r")
    ).withColumn("_text", F.array_join(F.transform("_r", lambda r: r["remarks"]), " | "))
    return daily.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct("_day", "_text"))).alias("_d")
    ).select("incident_id", F.btrim(
        F.array_join(F.transform("_d", lambda d: d["_text"]), " | "), F.lit(" |")
    ).alias("analyst_feedback"))


def snapshot(audit: DataFrame) -> DataFrame:
    """Mergeable state of each incident with actions: one row, whatever their number. ``current_state`` reads it.

    The label follows the last action that sets one. ``closed``, once true, stays so, also when the incident is reopened:
    its attack type is then normal.
    """
    closing, opening = F.col("new_status").isin(V.CLOSING_STATUSES), F.col("new_status").isin(V.OPENING_STATUSES)
    label = F.when(closing, "normal").when(opening, "anomaly")
    return audit.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("actions"), F.max(F.struct("timestamp", "new_status", "analyst")).alias("last_action"),
        F.max(F.when(label.isNotNull(), F.struct("timestamp", "new_status", label.alias("label")))).alias("last_label"),
        F.max(closing).alias("closed"))


def merge_snapshots(stored: DataFrame, newer: DataFrame) -> DataFrame:
    """State of the actions behind both; the order in which they arrived does not matter."""
    return stored.unionByName(newer).groupBy("incident_id").agg(
        F.sum("actions").alias("actions"), *[F.max(c).alias(c) for c in ("last_action", "last_label", "closed")])


def current_state(state: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Snapshot rows in the form that ``with_state`` joins with the events, with feedback texts where they are wanted."""
    out = state.select(
        "incident_id", F.col("last_action.new_status").alias("status"), F.col("last_action.timestamp").alias("last_updated"),
        F.col("last_action.analyst").alias("updated_by"), F.col("last_label.label").alias("_label"), F.col("closed").alias("_closed"))
    if feedback is None:
        return out.withColumn("analyst_feedback", F.lit(None).cast("string"))
    return out.join(feedback, "incident_id", "left")


def remark_chunks(audit: DataFrame, size: int = 1000, hot: HotKeys | None = None) -> DataFrame:
    """Non-blank remarks in rows of at most ``size`` of them: (incident_id, event_date, chunk, remarks, remark_text), in time order.

    The remarks of a day are numbered without being gathered, so no row grows with an incident's remarks. Another day, taken
    whole, only appends rows. ``hot`` comes from ``find_hot_keys(audit, ["incident_id", "event_date"])``.
    """
    dated = audit.where(F.coalesce("remarks", F.lit("")) != "").withColumn("event_date", F.to_date("timestamp")).withColumn(
        "_tie", F.struct("new_status", "remarks"))
    placed = with_position(dated, ["incident_id", "event_date"], "_k", tie="_tie", hot=hot)
    chunks = placed.groupBy("incident_id", "event_date", F.floor((F.col("_k") - 1) / size).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_k", "remarks"))).alias("_r"))
    text = F.array_join(F.transform("_r", lambda r: r["remarks"]), " | ")
    return chunks.select("incident_id", "event_date", "chunk", F.size("_r").cast("bigint").alias("remarks"), text.alias("remark_text"))


def feedback_of_chunks(chunks: DataFrame) -> DataFrame:
    """The texts of ``feedback_texts`` from stored chunks, for incidents whose whole text is to be shown."""
    return chunks.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("event_date", "chunk", "remark_text"))).alias("_c")).select(
        "incident_id", F.btrim(F.array_join(F.transform("_c", lambda c: c["remark_text"]), " | "), F.lit(" |")).alias("analyst_feedback"))


def apply_actions(events: DataFrame, audit: DataFrame) -> DataFrame:
    """Current state of every event: status, feedback, labels. No table is rewritten."""
    return with_state(events, current_state(snapshot(audit), feedback_texts(audit)))


def with_state(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events with the current state of those that have any; a snapshot and what came after it suffice."""
    state = state.withColumnsRenamed({
        "incident_id": "event_id", "status": "_status", "last_updated": "_updated", "updated_by": "_by", "analyst_feedback": "_feedback",
    })
    initial = F.when(F.col("label") == "anomaly", "LIVE_THREAT").otherwise("BENIGN")
    joined = events.drop("status", "analyst_feedback", "last_updated", "updated_by").join(state, "event_id", "left")
    return joined.withColumns({
        "status": F.coalesce("_status", initial),
        "analyst_feedback": F.coalesce("_feedback", F.lit("")),
        "last_updated": F.coalesce(F.date_format("_updated", "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        "updated_by": F.coalesce("_by", F.lit("")),
        "attack_type": F.when(F.col("_closed"), "normal").otherwise(F.col("attack_type")),
        "label": F.coalesce("_label", "label"),
    }).drop("_status", "_updated", "_by", "_feedback", "_label", "_closed")


def feedback_status(is_false_positive: Column) -> Column:
    return F.when(is_false_positive, "False Positive").otherwise("Confirmed Attack")


def status_code(name: Column) -> Column:
    """Status code of a form choice; unknown choices confirm the threat."""
    return lookup(name, V.STATUS_CODES, "CONFIRMED_THREAT")


def triage_incidents(records: DataFrame, audit: DataFrame) -> DataFrame:
    """Incident records with the state and comments of their latest triage."""
    state = latest_actions(audit).join(feedback_texts(audit), "incident_id", "left").select(
        "incident_id", F.col("status").alias("_status"), F.col("analyst_feedback").alias("_comments"),
        F.col("updated_by").alias("_by"),
    )
    return records.join(state, "incident_id", "left").withColumns({
        "incident_status": F.coalesce("_status", "incident_status"),
        "comments": F.coalesce("_comments", F.lit("")),
        "assessed_by": F.coalesce("_by", F.lit("UNASSIGNED")),
    }).drop("_status", "_comments", "_by")
