"""Operator 11 against plain Python, its edge cases, and what its intervals leave unread."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    own = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in ints) < 2**62:
            own.add((i, int(math.fmod(label + 1, 10)) if i % 7 == 0 else label, ints))
    out = []
    for a in own:
        if a[0] % 50:
            continue
        score = lambda x: sum(p * q for p, q in zip(a[2], x[2]))  # noqa: B023, E731
        same = sorted((-score(x), x[0]) for x in own if x[1] == a[1] and x[0] != a[0])[:5]
        for minus, positive in same:
            fit = sorted((-score(x), x[0]) for x in own if x[1] != a[1] and 50 * -minus <= 100 * score(x) <= 95 * -minus)[:3]
            out += [(a[0], positive, k + 1, n, -minus, -s) for k, (s, n) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in hard.mined(df).collect())


def test_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    assert got(df) == brute(rows)


def test_edges_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard, "CHUNK_ROWS", 16)
    monkeypatch.setattr(hard, "RING_ROWS", 1)
    monkeypatch.setattr(hard, "BLOCK", 3)
    monkeypatch.setattr(hard, "PRODUCT", 2)
    rng = random.Random(3)
    rows = [(k, [1.0, 0.5, -0.25], k % 3) for k in range(0, 200)]  # one vector for a third of the rows
    rows += [(k, [rng.uniform(-1, 1) for _ in range(3)], rng.randrange(-2, 12)) for k in range(200, 560)]
    rows += [(50, [9.0], 1), (50, [9.0], 1), (50, [0.1, 0.2], 1), (None, [1.0, 1.0, 1.0], 1), (600, None, 1), (650, [1.0], None), (700, [None, 1.0], 2), (750, [math.nan], 2), (800, [math.inf, 0.0], 1), (850, [], 1), (900, [0.0, 0.0, 0.0], 1), (950, [1e300], 1), (-50, [0.3, 0.3, 0.3], 2**31 - 1)]
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("v"), F.lit(2).alias("cell"), F.lit(3).alias("block"))
    assert got(clashing) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []  # no anchor
    assert got(spark.createDataFrame([(1, None, 1)], SCHEMA)) == []


def test_exact_beyond_floating_point(spark):
    rng = random.Random(4)
    rows = [(k, [2.0**20 + rng.random() / 128, 2.0**19 + rng.random() / 128], k % 2) for k in range(0, 120)] + [(500 + k, [2.0**19 + k / 256, 2.0**19], 5) for k in range(20)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_intervals_leave_cells_unread_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard, "RING_ROWS", 8)
    monkeypatch.setattr(hard, "BLOCK", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(int(k), [float(x) for x in centres[k % 40] + rng.normal(size=8) / 20], int(k % 40 // 2 % 10)) for k in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = hard.Index(df)
    queries = index.blocks(index.keyed.where("vec_id % 50 = 0"))
    hits = index.search(queries, 5, True)
    assert index.asked < 0.5 * len(index.cells) * queries.count()
    ints = np.floor(256 * np.array([v for _, v, _ in rows]))
    label = np.array([(l + 1) % 10 if i % 7 == 0 else l for i, _, l in rows])
    ids = {r["block"]: np.frombuffer(r["ids"], "<i8") for r in queries.select("block", "ids").collect()}
    found = {}
    for r in hits.collect():
        found.setdefault(int(ids[r["block"]][r["q"]]), []).append((r["rank"], r["vec_id"]))
    for a in range(0, 4000, 50):
        s = ints @ ints[a]
        best = sorted((-s[k], k) for k in range(4000) if k != a and label[k] == label[a])[:5]
        assert [k for _, k in sorted(found[a])] == [k for _, k in best]


def test_assigned_pivots_and_rings_hold_every_row(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = hard.Index(df)
    assert index.sizes.sum() == df.count() and (index.lo <= index.hi).all()
