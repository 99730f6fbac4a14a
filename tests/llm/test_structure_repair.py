import hashlib
import heapq
import itertools
import random
import re

import numpy as np
import pytest

from wardenlog.llm import structure_repair as S

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, pos string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """Uniform-cost search over (turns read, last initial), by cost and then letters. turns: (initial, must go, extra cost)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, letters
        role = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, letters + "I", i, role))
        if i < len(turns):
            initial, gone, extra = turns[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, last))
            if not gone:
                heapq.heappush(heap, (cost + 3 + extra, letters + "R", i + 1, role))
                if initial in FOLLOWS[last] and initial:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, initial))


def brute(rows):
    groups, out = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, kinds = set(), []
        for _, role, text in turns:
            if not re.search(r"[^\x20\x09-\x0D]", text):
                kinds.append("blank")
            elif (role, text) in seen:
                kinds.append("duplicate")
            else:
                kinds.append("truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "")
            seen.add((role, text))
        cost, audit = cheapest([(t[1][:1], k in ("blank", "duplicate"), 3 * (k == "truncated")) for t, k in zip(turns, kinds)])
        lines, at, last = [], 0, ""
        for letter in audit:
            role = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(role + ":")
            else:
                _, own, text = turns[at]
                at += 1
                if letter == "D":
                    continue
                role = own if letter == "K" else role
                lines.append(role + ":" + text)
            last = role[0]
        there = [t[0] for t in turns if t[0] is not None]
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def of(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.conv: tuple(r[n] for n in NAMES) for r in S.repair(S.in_order(df.repartition(3)), **more).collect()}


@pytest.mark.parametrize("block", [1, 3, 4])
def test_every_short_sequence(block):
    tables = S.Tables(block)
    symbols = [("s", 0, 0), ("u", 0, 0), ("a", 0, 0), ("", 0, 0), ("s", 0, 3), ("u", 0, 3), ("a", 0, 3), ("", 0, 3), ("", 1, 0)]
    for n in range(5):
        every = list(itertools.product(range(9), repeat=n)) if n < 4 else random.Random(1).choices(list(itertools.product(range(9), repeat=n)), k=1500)
        costs, letters = tables.repair([np.array(s, np.int64) for s in every])
        for s, cost, mine in zip(every, costs.tolist(), letters):
            assert (cost, "".join(mine)) == cheapest([symbols[x] for x in s])


def test_same_as_definition(spark):
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "", None, "  \n", "cut off", "Why? \t", "é…", "end. "]
    rows = [(c, t if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant"]),
             rnd.choice(texts) if rnd.random() < 0.4 else f"text {rnd.random()}.") for c in range(150) for t in range(rnd.randint(1, 14))]
    rows += [(None, 1, "user", "of no conversation."), (None, 2, "assistant", "Yes.")]
    # A conversation that holds a third of all turns, mostly the same one, over many pieces.
    rows += [(1000, t, "assistant" if t % 5 else "user", "again and again" if t % 3 else f"turn {t}.") for t in range(600)]
    rnd.shuffle(rows)
    assert of(spark, rows, piece=64, shard_rows=100) == brute(rows)


def test_no_turns(spark):
    assert of(spark, []) == {}
