"""History features on a stream from keyed state: each event's predecessor and rolling windows, in event-time order.

An entity's (or address's) events wait in its state until the watermark has passed them, when a timer lets them out; all that can
still arrive is later, so a late event gets its true predecessor and counts in the windows of those after it. A redelivered event is
known by its id. Events behind the longest window leave the state; the latest stays, as the predecessor of the next.

The state of a key is what it did within the longest window. Per trigger a key costs its own state, and only keys with new events or
due timers are touched. For entities that are too busy for one state there is ``streams.HistoryFeatures``, which is split by time.

Defined cases: null keys are a key of their own; null values are not counted, null numbers add nothing; events of equal time are
ordered by their ids; an event older than the watermark when it arrives is dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import EARTH_RADIUS_KM, flag, micros
from ..operators.features import MAX_SPEED_KMH, hour_is_off

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR, DAY = 3_600_000_000, 86_400_000_000
_STATE = "us bigint, event_id string, lat double, lon double, failed bigint, bytes bigint, off bigint, first string, second string"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]
_FAILED, _BYTES, _OFF, _FIRST, _SECOND = 4, 5, 6, 7, 8

#: Name, what is added (-1: one for each event), width: sums over [t - width, t).
ENTITY_SUMS = [("failed_auth_count_1h", _FAILED, HOUR), ("total_events_1h", -1, HOUR), ("failed_auth_count_24h", _FAILED, DAY),
               ("bytes_total_24h", _BYTES, DAY), ("off_hours_event_count_7d", _OFF, 7 * DAY)]
#: Name, whose values are counted, width: distinct values over [t - width, t].
ENTITY_DISTINCT = [("unique_resources_1h", _FIRST, HOUR), ("unique_resources_24h", _FIRST, DAY), ("unique_geos_24h", _SECOND, DAY)]
ADDRESS_DISTINCT = [("unique_entities_per_ip_1h", _FIRST, HOUR)]


def trailing(rows: list[tuple], wanted: np.ndarray, sums: list[tuple[str, int, int]], distinct: list[tuple[str, int, int]]) -> dict[str, list]:
    """Measures of the wanted rows among a key's rows, which are sorted by time and id."""
    us = np.array([r[0] for r in rows], np.int64)
    at = us[wanted]
    out: dict[str, list] = {}
    for name, column, width in sums:
        added = np.concatenate([[0], np.cumsum([1 if column < 0 else r[column] or 0 for r in rows])])
        out[name] = (added[np.searchsorted(us, at, "left")] - added[np.searchsorted(us, at - width, "left")]).tolist()
    for name, column, width in distinct:
        counts, low, high, values = Counter(), 0, 0, []
        for first, last in zip(np.searchsorted(us, at - width, "left").tolist(), np.searchsorted(us, at, "right").tolist()):
            for r in rows[high:last]:
                counts[r[column]] += 1
            for r in rows[low:first]:
                counts[r[column]] -= 1
                if not counts[r[column]]:
                    del counts[r[column]]
            low, high = first, last
            values.append(len(counts) - (None in counts))
        out[name] = values
    return out


def travelled(rows: list[tuple], wanted: np.ndarray) -> dict[str, list]:
    """Minutes, distance and speed since the row before."""
    out: dict[str, list] = {"minutes_since_last": [], "geo_distance_km": [], "geo_velocity_kmh": []}
    for i in wanted.tolist():
        minutes, km, speed = -1.0, 0.0, 0.0
        if i:
            (u, _, lat_a, lon_a, *_), (v, _, lat_b, lon_b, *_) = rows[i - 1], rows[i]
            minutes = (v - u) / 60e6
            if None not in (lat_a, lon_a, lat_b, lon_b):
                a = (np.sin(np.radians(lat_b - lat_a) / 2) ** 2
                     + np.cos(np.radians(lat_a)) * np.cos(np.radians(lat_b)) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2)
                km = float(2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a)))
            speed = min(km / (minutes / 60), MAX_SPEED_KMH) if minutes else 0.0
        for c, x in zip(out.values(), (minutes, km, speed)):
            c.append(x)
    return out


class History(StatefulProcessor):
    """Lets a key's events out in order of time, with measures over those before."""

    def __init__(self, sums: list[tuple[str, int, int]], distinct: list[tuple[str, int, int]], travels: bool):
        self.sums, self.distinct, self.travels = sums, distinct, travels
        self.reach = max(width for _, _, width in [*sums, *distinct])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Events that wait for the watermark, and those that were let out and still count.
        self.waiting, self.past = handle.getListState("waiting", _STATE), handle.getListState("past", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {r[1] for state in (self.waiting, self.past) for r in self._rows(state)}
        new = []
        for part in rows:
            for r in zip(*(part[f].tolist() for f in _FIELDS)):
                if r[1] not in known:
                    known.add(r[1])
                    new.append(tuple(None if x is None or x != x else x for x in r))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._rows(self.waiting)
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2])
        rest = [r for r in waiting if r[0] > passed]
        if due:
            past = self._rows(self.past)
            rows = past + due
            wanted = np.arange(len(past), len(rows))
            out = {"event_id": [r[1] for r in due]} | trailing(rows, wanted, self.sums, self.distinct)
            if self.travels:
                out |= travelled(rows, wanted)
            # The watermark, and so what comes next, is not before `passed`.
            kept = [r for r in rows[:-1] if r[0] >= passed - self.reach] + rows[-1:]
            self.past.put(kept)
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame(out)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _keyed(events: DataFrame, key: str, first: str, second: str | None, processor: History, schema: str, delay: str) -> DataFrame:
    use_state_store(events.sparkSession)
    rows = events.select(
        F.col(key).alias("key"), F.col("timestamp").cast("timestamp").alias("event_time"), micros("timestamp").alias("us"), "event_id",
        F.col("geo_lat").alias("lat"), F.col("geo_lon").alias("lon"), flag(F.col("auth_status") == "failure").cast("bigint").alias("failed"),
        F.col("bytes_transferred").cast("bigint").alias("bytes"), flag(hour_is_off(F.hour("timestamp"))).cast("bigint").alias("off"),
        F.col(first).alias("first"), (F.col(second) if second else F.lit(None).cast("string")).alias("second"))
    return rows.withWatermark("event_time", delay).groupBy("key").transformWithStateInPandas(processor, schema, "append", "eventTime")


def entity_history(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of event_id, travel features and windows of the event's entity."""
    schema = "event_id string, " + ", ".join(f"{n} bigint" for n, *_ in [*ENTITY_SUMS, *ENTITY_DISTINCT]) + \
        ", minutes_since_last double, geo_distance_km double, geo_velocity_kmh double"
    return _keyed(events, "entity_id", "resource_accessed", "geo_location", History(ENTITY_SUMS, ENTITY_DISTINCT, True), schema, delay)


def address_history(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of event_id and windows of the event's source address."""
    return _keyed(events, "source_ip", "entity_id", None, History([], ADDRESS_DISTINCT, False), "event_id string, unique_entities_per_ip_1h bigint", delay)
