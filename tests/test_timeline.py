"""Ordered computations against brute force, with and without splitting of hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardenlog.functions.columns import HOUR, MINUTE
from wardenlog.functions.timeline import (
    Trailing, TrailingDistinct, find_hot_keys, with_position, with_previous, with_trailing,
)

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id string, timestamp timestamp_ntz, k string, v long, c string"


def rows():
    rng = random.Random(7)
    out = []
    for i in range(400):
        # One key holds half of all rows; many events share their time.
        key = "hot" if i % 2 else rng.choice("abcd")
        at = START + dt.timedelta(minutes=rng.randrange(0, 600, 5), microseconds=rng.choice([0, 0, 1]))
        out.append((f"e{i:04d}", at, key, rng.randrange(-3, 10), rng.choice("xyz")))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(params=[10_000_000, 20], ids=["plain", "split"])
def hot(request, data):
    found = find_hot_keys(data, "k", max_rows=request.param)
    assert bool(found) == (request.param == 20)
    return found


def test_trailing_frames(data, hot):
    hour, short = HOUR, 20 * MINUTE
    measures = [
        Trailing("s", F.col("v"), hour), Trailing("n", F.lit(1), short), Trailing("si", F.col("v"), hour, inclusive=True),
        TrailingDistinct("d", "c", short), TrailingDistinct("d2", "c", hour),
    ]
    got = {r["event_id"]: r for r in with_trailing(data, "k", measures, hot).collect()}
    all_rows = rows()
    assert len(got) == len(all_rows)
    us = lambda t: (t - START) // dt.timedelta(microseconds=1)
    for e, t, k, v, c in all_rows:
        near = [(us(t) - us(t2), v2, c2) for _, t2, k2, v2, c2 in all_rows if k2 == k]
        want = {
            "s": sum(v2 for d, v2, _ in near if 0 < d <= hour),
            "n": sum(1 for d, _, _ in near if 0 < d <= short),
            "si": sum(v2 for d, v2, _ in near if 0 <= d <= hour),
            "d": len({c2 for d, _, c2 in near if 0 <= d <= short}),
            "d2": len({c2 for d, _, c2 in near if 0 <= d <= hour}),
        }
        assert {m: got[e][m] for m in want} == want
        assert (got[e]["v"], got[e]["c"], got[e]["timestamp"]) == (v, c, t)


def test_previous_and_position(data, hot):
    out = with_position(with_previous(data, "k", {"v": "pv", "event_id": "pe"}, hot=hot), "k", "pos", hot=hot)
    got = {r["event_id"]: r for r in out.collect()}
    by_key = {}
    for row in sorted(rows(), key=lambda r: (r[1], r[0])):
        by_key.setdefault(row[2], []).append(row)
    for ordered in by_key.values():
        for i, row in enumerate(ordered):
            before = ordered[i - 1] if i else None
            r = got[row[0]]
            assert r["pos"] == i + 1
            assert (r["pe"], r["pv"]) == ((before[0], before[3]) if before else (None, None))
