"""Operator 13 against a plain search over all edits, and its edge cases."""

import hashlib
import heapq
import re
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from skein.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 1:
            x = ""
        if d == 2:
            x = re.sub("[.!?]", "", x)
        if d == 4:
            r = "user"
        out += [(c, t, r, x)] * {0: 0, 3: 2}.get(d, 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). Best-first over (cost, audit): the first whole repair found is the one wanted."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", at, step[state, role[0]], (*out, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault in (0, 3):
                extra = fault == 3
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, step[state, role[:1]], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, step[state, new[0]], (*out, f"{new}:{text}")))
    raise AssertionError


def brute(rows):
    low = lambda v: (v is not None, v or 0)
    after = sorted(brute_damage(rows), key=lambda r: (low(r[0]), low(r[1]), r[2].encode(), r[3].encode()))
    by = {k: list(g) for k, g in groupby(after, key=lambda r: r[0])}
    out = []
    for conv in {r[0] for r in rows}:
        own, seen, faults = by.get(conv, []), set(), []
        for _, _, r, x in own:
            body = x.rstrip(SPACE)
            faults.append(1 if not body else 2 if (r, x) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((r, x))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = cheapest([(r, x, f) for (_, _, r, x), f in zip(own, faults)])
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in repair.digest(df).collect()), key=str)


def test_equals_a_search_over_all_edits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(turns) == brute([tuple(r) for r in turns.collect()])


def test_edges_have_defined_results(spark):
    rows = [(1, None, None, None), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "tool", "x"), (None, 3, "user", "lost"), (None, None, "assistant", "ok!"), (2, 0, "", "no role?"), (2, 5, "user", ""), (3, -(2**63), "user", "a."), (3, 2**63 - 1, "assistant", "b.  \n")]
    rows += [(k, t, r, x) for k in range(10, 40) for t, (r, x) in enumerate([("system", "Be."), ("user", "q?"), ("assistant", "cut off"), ("assistant", "A."), ("user", "  "), ("narrator", "…")])]
    plain = spark.createDataFrame(rows, SCHEMA)
    want = [r if r[1] < 2**63 else (r[0], None, *r[2:]) for r in brute(rows)]
    assert got(plain) == sorted(want, key=str)
    assert got(plain.select("*", F.lit(1).alias("m"), F.lit("x").alias("block"), F.lit(2).alias("audit"))) == sorted(want, key=str)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(7, gone, "user", "Hi.")], SCHEMA)) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversations_are_composed_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(repair, "FAN", 3)
    import random

    rng = random.Random(5)
    rows = [(c, t // 2, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "Yes.", "No!", "cut", "why?", f"{t}.", f"{t}"])) for c in range(6) for t in range(90)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_long_texts_and_many_rows(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t} says so.") for t in range(3000)] + [(2, 1, "user", "x " * 200_000 + " " * 200_000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
