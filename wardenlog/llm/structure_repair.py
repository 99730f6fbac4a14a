"""Repair of the structure of conversations: the cheapest edits after which roles alternate and no turn is blank or repeated.

Edits of turns in order: K keeps a turn, R gives it the role that must follow, D deletes it, I inserts an empty turn of that
role. Valid are sequences of role initials (s?(ua)+)? and an undeleted truncated turn costs extra. Four states of the
sequence so far (nothing, after s, after u, after a) make the repair a shortest path whose cost to go is a vector of four.

Four Russians: turns are symbols (role initial and fault). As an edit costs little, a vector less its minimum is one of a few;
these are enumerated, and for each of them and every block of BLOCK symbols a table gives the vector before the block and
what the minimum grows by. A conversation is looked up block by block from its end, all conversations of a task together.
Then the blocks are expanded the other way, from the start, by the table of single symbols: at each turn the edit of least
letter among those that stay on a cheapest path is taken, so of equal costs the least string of letters results.

Scale: conversations may be of any length. Places come from running sums over all tasks, faults by equal turns from
aggregates, symbols are gathered in pieces of PIECE turns. One task holds the symbols and edits of one conversation, two bytes
a turn, as its result holds the edits anyway; texts pass it one by one, as a SHA-256 over them must read them in order.

Defined cases: null roles and texts are one space; null ids are one conversation; turns are in the order of `turn`, nulls first, and
those of equal number in that of their role, the first 64 characters of their text, and a digest; repeated rows are turns of
their own (and so duplicates); a conversation without turns has no edits; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from .common import column
from .ordered import map_rows, running

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK, PIECE, SHARD_ROWS = 4, 65536, 200_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: States: nothing yet, after s, after u, after a. Where a turn of the role that must follow leads.
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: Where a kept turn leads, by role initial (s, u, a, other) and state.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Symbols: role initial, 4 more if truncated; must be deleted; nothing.
GONE, NOTHING = 8, 9
_SPACE = r"[^\x20\x09-\x0D]"
_FAR = 1 << 20


def _with_inserts(w: list[int]) -> list[int]:
    for _ in range(3):
        w = [min(x, INSERT + w[NEXT[q]]) for q, x in enumerate(w)]
    return w


def _options(symbol: int, state: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """Letter, cost to go and next state of the edits of a turn."""
    yield "D", DELETE + after[state], state
    if symbol < GONE:
        extra = TRUNCATED if symbol >= 4 else 0
        if (to := KEPT[symbol % 4].get(state)) is not None:
            yield "K", KEEP + extra + after[to], to
        yield "R", REROLE + extra + after[NEXT[state]], NEXT[state]


class Tables:
    """Vectors of costs to go (less their minimum), and what symbols and blocks make of them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = tuple(_with_inserts([0, _FAR, _FAR, 0]))
        self.vectors, at, step, grown = [end], {end: 0}, [], []
        for vector in self.vectors:  # grows until no symbol makes a new one
            made = []
            for symbol in range(NOTHING):
                w = _with_inserts([min(c for _, c, _ in _options(symbol, q, vector)) for q in range(4)])
                low = min(w)
                w = tuple(x - low for x in w)
                if w not in at:
                    at[w] = len(self.vectors)
                    self.vectors.append(w)
                made.append((at[w], low))
            step.append([v for v, _ in made] + [at[vector]])
            grown.append([g for _, g in made] + [0])
        self.step, grown = np.array(step), np.array(grown)
        codes = np.arange((NOTHING + 1) ** block)
        self.to = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        self.grown = np.zeros(self.to.shape, np.int64)
        for k in range(block):  # the block's last symbol is its code's last digit, and comes first
            digit = codes // (NOTHING + 1) ** k % (NOTHING + 1)
            self.grown += grown[self.to, digit]
            self.to = self.step[self.to, digit]
        #: What is done at a turn, by vector behind it, symbol and state: letters and the next state.
        self.edits = {(v, s, q): self._edit(s, q, vector) for v, vector in enumerate(self.vectors) for s in range(NOTHING) for q in range(4)}
        self.back = self.step.tolist()

    @staticmethod
    def _edit(symbol: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
        w = _with_inserts([min(c for _, c, _ in _options(symbol, q, after)) for q in range(4)])
        letters = ""
        while True:
            options = [*_options(symbol, state, after), ("I", INSERT + w[NEXT[state]], NEXT[state])]
            letter, _, to = min(o for o in options if o[1] == w[state])
            letters, state = letters + letter, to
            if letter != "I":
                return letters, state

    def repair(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, list[list[str]]]:
        """For conversations as symbols, the costs and each turn's letters; a conversation's last letters are inserts at its end."""
        base = NOTHING + 1
        blocks = [-(-len(s) // self.block) for s in symbols]
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1].astype(np.int64)
        codes = np.zeros(sum(blocks), np.int64)
        for s, n, at in zip(symbols, blocks, first.tolist()):
            whole = np.full(n * self.block, NOTHING, np.int64)
            whole[len(whole) - len(s):] = s  # what is missing stands before the first turn
            codes[at:at + n] = whole.reshape(n, self.block) @ base ** np.arange(self.block)[::-1]
        behind = np.zeros(len(codes), np.int64)
        order = np.argsort(-np.array(blocks, np.int64), kind="stable")
        now, cost = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        sizes = np.array(blocks, np.int64)[order]
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = order[:np.searchsorted(-sizes, -k, "left")]  # those that have more than k blocks
            at = first[live] + sizes[:len(live)] - 1 - k
            behind[at] = now[live]
            cost[live] += self.grown[now[live], codes[at]]
            now[live] = self.to[now[live], codes[at]]
        cost += np.array([self.vectors[v][0] for v in now.tolist()], np.int64)
        return cost, [self.trace(s.tolist(), behind[a:a + n].tolist()) for s, a, n in zip(symbols, first.tolist(), blocks)]

    def trace(self, symbols: list[int], behind: list[int]) -> list[str]:
        out, state, end = [], 0, len(symbols) - (len(behind) - 1) * self.block
        start = 0
        for vector in behind:
            part, vectors = symbols[start:end], []
            for symbol in reversed(part):
                vectors.append(vector)
                vector = self.back[vector][symbol]
            for symbol, v in zip(part, reversed(vectors)):
                letters, state = self.edits[v, symbol, state]
                out.append(letters)
            start, end = end, end + self.block
        tail = ""
        while state not in (0, 3):
            tail, state = tail + "I", NEXT[state]
        return [*out, tail]


_READY: list[Tables] = []


def tables() -> Tables:
    """One for each Python worker."""
    if not _READY:
        _READY.append(Tables())
    return _READY[0]


def in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Turns with their places: conv, turn, role, text, pos (from 1). `change` may alter turns (conv, turn, role,
    text) and add copies, numbered by o_copy, behind them; the order stays that of the turns before."""
    role, text = (F.coalesce(column(c), F.lit(" ")) for c in (role_col, text_col))
    turns = rows.select(column(conv_col).cast("long").alias("conv"), column(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        role.substr(1, 64).alias("o_role"), text.substr(1, 64).alias("o_text"), F.sha2(F.concat(role, F.lit(":"), text).cast("binary"), 256).alias("o_mark"),
                        F.lit(0).alias("o_copy"), F.lit(1).cast("long").alias("one"))
    turns = change(turns) if change else turns
    return running(turns, "conv", [F.col("turn").asc_nulls_first(), "o_role", "o_text", "o_mark", "o_copy"], {"pos": "one"}, "turns").select(
        "conv", "turn", "role", "text", "pos")


def repair(turns: DataFrame, piece: int = PIECE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each conversation of in_order(): conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = turns.sparkSession
    initial = F.expr("CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    blank = ~F.col("text").rlike(_SPACE)
    broken = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    mark = lambda k: F.xxhash64(F.lit(k), F.coalesce("conv", F.lit(0)), F.col("conv").isNull(), "role", "text")
    narrow = written(turns.select("conv", "turn", "pos", F.when(blank, initial + 8).otherwise(initial + F.when(broken, 4).otherwise(0)).alias("code"),
                                  mark(1).alias("d1"), mark(2).alias("d2")), "faults")
    # Equal turns are told apart from the first of them; only those that occur again are joined.
    again = narrow.filter("code < 8").groupBy("d1", "d2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = narrow.filter("code < 8").join(again, ["d1", "d2"]).filter("pos > first").select("conv", "pos", (F.lit(12) + F.col("code") % 4).alias("code"))
    shards = max(-(-narrow.count() // shard_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("conv"), F.lit(shards)).cast("int").alias("shard")
    codes = narrow.select("conv", "pos", "code").unionByName(later).select(shard, "conv", "pos", "code", F.floor((F.col("pos") - 1) / piece).cast("long").alias("seg"))

    def gathered(t: pa.Table) -> pa.Table:
        null = np.asarray(t.column("conv").is_null())
        conv = np.asarray(t.column("conv").fill_null(0))
        pos, code = np.asarray(t.column("pos")), np.asarray(t.column("code"))
        order = np.lexsort((code, pos, conv, null))
        null, conv, pos, code = null[order], conv[order], pos[order], code[order]
        # A turn that is a duplicate has two rows, of which the larger code counts.
        last = np.ones(len(pos), bool)
        last[:-1] = (pos[1:] != pos[:-1]) | (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])
        null, conv, code = null[last], conv[last], code[last].astype(np.uint8)
        borders = np.nonzero((conv[1:] != conv[:-1]) | (null[1:] != null[:-1]))[0] + 1
        starts = [0, *borders.tolist()]
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()] * len(starts), pa.int32()), "conv": pa.array([None if null[i] else int(conv[i]) for i in starts], pa.int64()),
            "seg": pa.array([t.column("seg")[0].as_py()] * len(starts), pa.int64()), "codes": pa.array([p.tobytes() for p in np.split(code, borders)], pa.binary())})

    pieces = codes.groupBy("shard", "seg").applyInArrow(gathered, "shard int, conv bigint, seg bigint, codes binary")
    plans = pieces.groupBy("shard").applyInArrow(_plans, _PLAN)
    plans = written(plans, "plans")
    texts = turns.select("conv", F.floor((F.col("pos") - 1) / piece).cast("long").alias("seg"), "pos", "role", "text")
    nothing = F.lit(None).cast("string")
    first = plans.select("conv", "seg", F.lit(0).cast("long").alias("pos"), nothing.alias("role"), nothing.alias("text"), *_COUNTS, "letters", "audit")
    both = first.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "seg", "pos")
    made = map_rows(both, _finished, "conv bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string")
    wide = lambda c: c.cast("decimal(38,0)")
    spans = narrow.groupBy("conv").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")).alias("gaps"))
    spans = spans.select(F.col("conv").alias("_conv"), F.least(F.coalesce("gaps", F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"))
    return made.join(spans, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "gaps", *_COUNTS, "audit", "repaired_sha256")


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_PLAN = "conv bigint, seg bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", letters string, audit string"


def _plans(t: pa.Table) -> pa.Table:
    """The edits of a shard's conversations: a row for each piece; counts and the whole audit stand at the first."""
    found: dict[int | None, list[tuple[int, bytes]]] = {}
    for c, s, codes in zip(t.column("conv").to_pylist(), t.column("seg").to_pylist(), t.column("codes").to_pylist()):
        found.setdefault(c, []).append((s, codes))
    convs = list(found)
    codes = [np.frombuffer(b"".join(x for _, x in sorted(found[c])), np.uint8).astype(np.int64) for c in convs]
    costs, letters = tables().repair([np.minimum(c, GONE) for c in codes])
    out: dict[str, list] = {c: [] for c in ("conv", "seg", *_COUNTS, "letters", "audit")}
    legal = np.zeros((4, 4), bool)
    legal[[0, 1, 2], [1, 2, 1]] = True
    for c, code, cost, mine in zip(convs, codes, costs.tolist(), letters):
        role = code % 4
        counts = [int((code // 4 == 2).sum()), int((code // 4 == 3).sum()), int((code // 4 == 1).sum()), int((~legal[role[:-1], role[1:]]).sum()), cost]
        at = 0
        for s, part in sorted(found[c]):
            end = at + len(part) if s < max(x for x, _ in found[c]) else len(mine)
            for name, value in zip(out, (c, s, *(counts if s == 0 else [0] * 5), "".join(mine[at:end]), "".join(mine) if s == 0 else None)):
                out[name].append(value)
            at = end
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.table({name: pa.array(x, kind) for (name, x), kind in zip(out.items(), types)})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Follow the edits through the turns of each conversation; a piece's edits come before its turns."""
    sha, head, letters, at, state, lines = None, None, "", 0, 0, 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        lines += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            line(ROLES[state], "")
            at, state = at + 1, NEXT[state]

    for batch in batches:
        for conv, seg, pos, role, text, *more in zip(*(c.to_pylist() for c in batch.columns)):
            if pos == 0:
                if sha is not None:
                    inserted()
                if seg == 0:
                    if sha is not None:
                        yield (*head, sha.hexdigest())
                    sha, head, state, lines = hashlib.sha256(), (conv, *more[:5], more[6]), 0, 0
                letters, at = more[5], 0
                continue
            inserted()
            letter, at = letters[at], at + 1
            if letter == "K":
                line(role, text)
                state = KEPT["sua".index(role[0])][state]
            elif letter == "R":
                line(ROLES[state], text)
                state = NEXT[state]
    if sha is not None:
        inserted()
        yield (*head, sha.hexdigest())
