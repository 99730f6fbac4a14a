"""Conversation prefix trie: how much conversations share of their beginnings, and what a cache of prefixes would save.

Every distinct sequence of first turns is a node, told by a digest: the sum of hashes of (place, role, text) of its turns, two
lanes of 64 bits, which running sums give for conversations of any length. Conversations are dealt to shards. A shard
tabulates its nodes: a minimal perfect hash gives each distinct digest a slot, the digest kept there verifies each lookup, and
counts are scattered into flat arrays by slot. Tables of shards are added by digest, which gives every node's members.

Sums over subtrees: only nodes with two or more members need them, as below the others there is one conversation. What a node
adds (its own saving, its childless children) stands in one shard only, that of its smallest member. Each shard has all
ancestors of its nodes, so it accumulates through an array of parents' slots from the deepest nodes up, and the shards' results
are added by digest. No shard holds more than its conversations, and none waits for another.

The digests are verified: all members of a node must have equal parents and equal hashes (SHA-256) of their last turns.
Otherwise the hashes are salted anew and all is repeated.

Bounds: a shard holds about SHARD_ROWS turns as numbers; the shared turns of one conversation are held together, about 100
bytes each. The digest of the conversations that end at a node is a SHA-256 of their list, a stream that one task must read;
the list comes to it in pieces of PIECE ids, sorted before.

Defined cases: null role or text are empty; rows without a conversation id take no part; turns are in the order of `turn`, nulls
first, and turns of equal number in that of their role, the first 64
characters of their text, and a digest; repeated rows are turns of their own; an empty table gives no node;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import written
from .common import column
from .ordered import map_rows, running

SHARD_ROWS = 200_000
#: Places that are tabulated together.
BAND = 4096
#: Ids in a piece of a list.
PIECE = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODE = "l1 bigint, l2 bigint, p1 bigint, p2 bigint, depth bigint, n bigint, conv bigint, ends bigint, bytes bigint, mark string"


class SlotTable:
    """Minimal perfect hash of distinct keys (two lanes each) to 0 .. n-1, with the keys kept at their slots.

    In each level the keys that are left are hashed into as many places; those that are alone there stay. A key's slot is the
    number of taken places before its own, over all levels.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        self.keys, left, first = np.zeros((len(keys), 2), np.int64), keys, 0
        while len(left):
            size = max(2 * len(left), 8)
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - 1
            stay = alone[place]
            self.keys[first + ranks[place[stay]]] = left[stay]
            self.levels.append((size, np.where(alone, ranks, -1), first))
            first += int(stay.sum())
            left = left[~stay]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0].astype(np.uint64) ^ (keys[:, 1].astype(np.uint64) + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that are not in the table."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, ranks, first) in enumerate(self.levels):
            rank = ranks[self._place(keys[open_], level, size)]
            hit = rank >= 0
            out[open_[hit]] = first + rank[hit]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = (self.keys[out[known]] == keys[known]).all(axis=1)
        return np.where(known, out, -1)


def distinct(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, axis=0)


def _lanes(t: pa.Table, a: str, b: str) -> np.ndarray:
    return np.stack([np.asarray(t.column(a)), np.asarray(t.column(b))], axis=1)


def tabulate(t: pa.Table) -> pa.Table:
    """The nodes of a shard's turns: how many of them stand at each node, the smallest conversation, the number that end there."""
    keys = _lanes(t, "l1", "l2")
    table = SlotTable(distinct(keys))
    slot = table.find(keys)
    conv = np.asarray(t.column("conv"))
    n = np.bincount(slot, minlength=len(table))
    least = np.full(len(table), np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    ends = np.zeros(len(table), np.int64)
    np.add.at(ends, slot, np.asarray(t.column("last")).astype(np.int64))
    row = np.zeros(len(table), np.int64)
    row[slot] = np.arange(len(slot))
    marks = t.column("mark").combine_chunks()
    # Members of a node that differ in what the node must determine show in the node's mark.
    same = np.ones(len(table), bool)
    for c in ("p1", "p2", "depth"):
        x = np.asarray(t.column(c))
        np.logical_and.at(same, slot, x == x[row[slot]])
    codes = np.asarray(marks.dictionary_encode().indices)
    np.logical_and.at(same, slot, codes == codes[row[slot]])
    picked = t.take(pa.array(row))
    mark = [m if ok else "differs" for m, ok in zip(picked.column("mark").to_pylist(), same.tolist())]
    return pa.table({
        "shard": picked.column("shard"), "l1": table.keys[:, 0], "l2": table.keys[:, 1], "p1": picked.column("p1"), "p2": picked.column("p2"),
        "depth": picked.column("depth"), "n": n.astype(np.int64), "conv": least, "ends": ends, "bytes": picked.column("bytes"), "mark": mark})


def accumulate(t: pa.Table) -> pa.Table:
    """For each node of a shard, what stands in its subtree: leaves and savings of the nodes that the shard accounts for."""
    keys, parents, depth = _lanes(t, "l1", "l2"), _lanes(t, "p1", "p2"), np.asarray(t.column("depth"))
    table = SlotTable(distinct(np.concatenate([keys, parents])))
    slot = table.find(keys)
    parent = np.full(len(table), -1, np.int64)
    parent[slot] = table.find(parents)
    level = np.zeros(len(table), np.int64)
    level[slot] = depth
    sums = []
    for c in ("own_leaves", "own_saved"):
        x = np.zeros(len(table), np.int64)
        np.add.at(x, slot, np.asarray(t.column(c)))
        sums.append(x)
    order = np.argsort(-level, kind="stable")
    borders = np.nonzero(np.diff(level[order]))[0] + 1
    for slots in np.split(order, borders):
        if level[slots[0]] > 0:
            for x in sums:
                np.add.at(x, parent[slots], x[slots])
    some = (sums[0] != 0) | (sums[1] != 0)
    return pa.table({"l1": table.keys[some, 0], "l2": table.keys[some, 1], "leaves": sums[0][some], "saved": sums[1][some]})


def turns_in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Columns conv, pos (from 1), h1, h2 (hashes of role and text), bytes, mark, of all rows that have a conversation."""
    role, text = (F.coalesce(column(c), F.lit("")) for c in (role_col, text_col))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = rows.filter(column(conv_col).isNotNull()).select(
        column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), mark.alias("mark"),
        F.octet_length(text).cast("long").alias("bytes"), role.substr(1, 64).alias("role"), F.substring(text, 1, 64).alias("head"), F.lit(1).cast("long").alias("one"))
    return running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("mark")], {"pos": "one"}, "turns").select("conv", "pos", "bytes", "mark")


def branched(turns: DataFrame, heads: Column, group: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that members of a group share beginnings: the first `heads` turns of the conversation `group`
    (columns of conv), then their own after these. Returns turns (conv, pos, bytes, mark) and conversations (conv, size)."""
    counts = written(turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"h": heads, "base": group}), "conversations")
    bases = counts.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    sized = counts.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).select(
        "conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    sized = written(sized, "rebuilt-sizes")
    first = turns.filter(F.col("pos") <= longest).withColumnRenamed("conv", "base").join(sized, "base").filter("pos <= taken")
    rest = turns.join(sized, "conv").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    names = ["conv", "pos", "bytes", "mark"]
    return first.select(*names).unionByName(rest.select(*names)), sized.select("conv", "size")


def trie(turns: DataFrame, sizes: DataFrame, shard_rows: int = SHARD_ROWS, salt: int = 0) -> DataFrame:
    """The nodes of conversations: turns (conv, pos from 1 without gaps, bytes, mark: equal for equal turns) and sizes (conv, size)."""
    spark = turns.sparkSession
    lane = lambda k: F.xxhash64(F.lit(2 * salt + k), "pos", "mark")
    hashed = turns.withColumns({"h1": lane(0), "h2": lane(1)})
    rows = running(hashed, "conv", [F.col("pos")], {"l1": "h1", "l2": "h2"}, "prefixes")
    count = rows.count()
    shards = max(-(-count // shard_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("conv"), F.lit(shards)).cast("int")
    rows = rows.join(sizes, "conv").select(
        shard.alias("shard"), "conv", F.col("pos").alias("depth"), "l1", "l2", *(_minus(F.col(f"l{k}"), F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)),
        (F.col("pos") == F.col("size")).alias("last"), "bytes", "mark")
    rows = written(rows, "digests")
    made = rows.withColumn("band", F.floor(F.col("depth") / BAND)).groupBy("shard", "band").applyInArrow(tabulate, "shard int, " + _NODE)
    local = written(made, "shard-nodes")
    same = lambda c: (F.min(c) == F.max(c))
    nodes = local.groupBy("l1", "l2").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("ends").alias("ends"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        (same("depth") & same("p1") & same("p2") & same("mark") & (F.max("mark") != "differs")).alias("verified"))
    nodes = written(nodes, "nodes")
    if nodes.filter("not verified or (l1 = 0 and l2 = 0)").limit(1).count():
        return trie(turns, sizes, shard_rows, salt + 1)
    root = sizes.agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if(F.col("size") == 0).alias("ends")).filter("n > 0")
    zero = F.lit(0).cast("long")
    root = root.withColumns({c: zero for c in ("l1", "l2", "p1", "p2", "depth", "bytes")})
    names = ["l1", "l2", "p1", "p2", "depth", "n", "conv", "ends", "bytes"]
    nodes = nodes.select(*names).unionByName(root.select(*names))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("l1"), F.col("p2").alias("l2")).agg(
        F.count("*").alias("children"), F.count_if(F.col("n") == 1).alias("single"))
    shared = nodes.filter("n > 1 or depth = 0").join(children, ["l1", "l2"], "left").withColumns(
        {"children": F.coalesce("children", zero), "single": F.coalesce("single", zero)})
    shared = written(shared, "shared-nodes")
    # What a node adds is accounted for in one shard, its smallest member's.
    owner = F.col("t.conv") == F.col("s.conv")
    at = shared.alias("s").join(
        local.select("shard", "l1", "l2", "conv").unionByName(root.select(shard.alias("shard"), "l1", "l2", "conv")).alias("t"), ["l1", "l2"])
    at = at.select("shard", "l1", "l2", "s.p1", "s.p2", "s.depth",
                   F.when(owner, F.when(F.col("children") == 0, 1).otherwise(F.col("single"))).otherwise(0).cast("long").alias("own_leaves"),
                   F.when(owner, (F.col("s.n") - 1) * F.col("s.bytes")).otherwise(0).alias("own_saved"))
    sums = at.groupBy("shard").applyInArrow(accumulate, "l1 bigint, l2 bigint, leaves bigint, saved bigint")
    sums = sums.groupBy("l1", "l2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ending = rows.filter("last").select("l1", "l2", "conv").unionByName(sizes.filter("size = 0").select(zero.alias("l1"), zero.alias("l2"), "conv"))
    above = shared.select(F.col("l1").alias("p1"), F.col("l2").alias("p2"), F.col("conv").alias("parent"))
    wide = shared.join(sums, ["l1", "l2"], "left").select(
        *names, "children", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"))
    alone = nodes.filter("n = 1 and depth > 0").select(
        *names, (1 - F.col("ends")).alias("children"), F.lit(1).cast("long").alias("leaves"), zero.alias("saved"))
    every = wide.unionByName(alone).join(above, ["p1", "p2"], "left").join(ended(ending), ["l1", "l2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv"))
    return every.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def _minus(a: Column, b: Column) -> Column:
    """Difference modulo 2^64: the high and low halves apart, as sums of longs must not overflow."""
    low = F.lit((1 << 32) - 1)
    lower = a.bitwiseAND(low) - b.bitwiseAND(low)
    upper = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(lower, 32)
    return F.shiftleft(upper, 32).bitwiseOR(lower.bitwiseAND(low))


def ended(ending: DataFrame) -> DataFrame:
    """SHA-256 of the sorted, comma-joined conversations (l1, l2, conv) of each node. Lists are put together in pieces by all
    tasks; a node's pieces are then one stream, of which a task holds one at a time."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        node, ids = None, []
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, b) != node or len(ids) == PIECE:
                    if ids:
                        yield (*node, ids[0], ",".join(map(str, ids)))
                    node, ids = (a, b), []
                ids.append(c)
        if ids:
            yield (*node, ids[0], ",".join(map(str, ids)))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        node, sha = None, None
        for batch in batches:
            for a, b, _, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (a, b) == node:
                    sha.update(b",")
                else:
                    if node:
                        yield (*node, sha.hexdigest())
                    node, sha = (a, b), hashlib.sha256()
                sha.update(text.encode())
        if node:
            yield (*node, sha.hexdigest())

    by = ["l1", "l2", "conv"]
    made = map_rows(ending.repartitionByRange(*by).sortWithinPartitions(*by), pieces, "l1 bigint, l2 bigint, first bigint, ids string")
    streams = made.repartition("l1", "l2").sortWithinPartitions("l1", "l2", "first")
    return map_rows(streams, digests, "l1 bigint, l2 bigint, ends_sha256 string")
