import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from wardenlog.llm import ordered, prefix_trie as P, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, conv string"


def turn_key(r):
    return (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def brute(rows):
    """The definition, by dictionaries of whole sequences."""
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made = own.get(base, [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append((c, d == len(made)))
    children, out = {}, []
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)

    def sums(seq):
        kids = children.get(seq, [])
        below = [sums(k) for k in kids]
        saved = (len(members[seq]) - 1) * (len(seq[-1][1].encode()) if seq else 0) + sum(s for _, s in below)
        leaves = sum(n for n, _ in below) if kids else 1
        ends = ",".join(str(c) for c, last in sorted(members[seq]) if last)
        out.append((min(members[seq])[0], len(seq), min(members[seq[:-1]])[0] if seq else None, len(members[seq]), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        sums(())
    return sorted(out, key=str)


def of(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    turns = P.turns_in_order(df.repartition(3))
    made = P.trie(*P.branched(turns, F.crc32(F.col("conv").cast("string").cast("binary")) % 9, F.col("conv") - F.col("conv") % 5, 8), **more)
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_same_as_definition(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", "", None, "long " * 9]))
            for c in range(-7, 60) for t in range(rnd.randint(1, 12)) if c % 7]
    rows += [(3, None, "user", "first"), (3, None, "user", "first"), (3, 2, None, None), (None, 1, "user", "of no conversation")]
    # Copies of one conversation, and one that holds a third of all turns.
    rows += [(c, t, "user", f"same {t}") for c in range(100, 200, 5) for t in range(9)]
    rows += [(300, t, "user", f"much {t % 7}") for t in range(400)]
    rnd.shuffle(rows)
    assert of(spark, rows, shard_rows=150) == brute(rows)


def test_turnless_and_empty(spark):
    # Conversation 4 takes its first turns from 0, which has none.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6)]
    assert of(spark, rows) == brute(rows)
    assert of(spark, []) == []


def test_slot_table():
    keys = P.distinct(np.random.default_rng(1).integers(-2**63, 2**63 - 1, (5000, 2)))
    table = P.SlotTable(keys)
    assert sorted(table.find(keys)) == list(range(5000))
    assert (table.find(keys + 1) == -1).all() and (table.keys[table.find(keys)] == keys).all()


def test_collisions_are_found():
    import pyarrow as pa

    t = pa.table({"shard": [0, 0], "conv": [1, 2], "depth": [1, 1], "l1": [5, 5], "l2": [6, 6], "p1": [0, 0], "p2": [0, 0],
                  "last": [True, True], "bytes": [1, 1], "mark": ["a", "b"]})
    assert P.tabulate(t).column("mark").to_pylist() == ["differs"]


def test_running_sums_over_tasks(spark):
    rows = [(k, i, 2**62 + i) for k in (None, 1, 2) for i in range(5 if k != 1 else 3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k bigint, i bigint, x bigint").repartition(4)
        made = ordered.running(df, "k", [F.col("i")], {"s": "x"}, "sums")
        got = {(r.k, r.i): r.s for r in made.collect()}
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for k in (None, 1, 2):
        total = 0
        for i in range(5 if k != 1 else 3000):
            total = ordered.wrapped(total + 2**62 + i)
            assert got[k, i] == total


def test_query_is_registered():
    assert "op11_prefix_trie" in queries.QUERIES
