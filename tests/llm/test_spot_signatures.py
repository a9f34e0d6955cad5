"""Operator 12 against a plain Python version, and its edge cases."""

import hashlib
import re

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from skein.llm import spot_signatures as spots

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
LOWER = str.maketrans(spots.UPPER_ASCII, spots.LOWER_ASCII)


def brute_spots(text):
    """Walks the words one by one."""
    found, content = [], []
    anchor = None
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)):
        if w in spots.ANCHORS:
            anchor = w
        else:
            content.append((anchor, w))
            anchor = None
    for i, (a, w) in enumerate(content):
        if a or i == 0 or len(w) % spots.OWN_LENGTH == 0:
            rest = " ".join(x for _, x in content[i + 1 : i + spots.CHAIN])
            found.append(hashlib.md5(f"{a + ' ' if a else ''}{w} {rest}".encode()).hexdigest()[: spots.DIGITS])
    return sorted(set(found))


def jaccard(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = brute_spots(t), brute_spots(edited), brute_spots(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), jaccard(a, b), jaccard(a, c), len(a)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in spots.digest(df).collect()), key=str)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)


def test_edges_have_defined_results(spark):
    rows = [(5, "The cat sat on the mat and the dog slept"), (4, None), (3, ""), (2, "x"), (1, "the of and"), (0, "Ünïcode é 😀 the 漢字 of wörld"), (None, "the lost id walks alone"), (7, "the same row"), (7, "the same row"), (9, "the " * 30000 + "end here")]
    plain = spark.createDataFrame(rows, DOCS)
    assert got(plain) == brute(rows)
    clashing = plain.select("*", F.lit("a").alias("spots"), F.lit(1).alias("g1"), F.lit(2).alias("n_chars"), F.lit(3).alias("j"))
    assert got(clashing) == brute(rows)
    assert got(spark.createDataFrame([], DOCS)) == []
    only = got(spark.createDataFrame([(1, "the quick fox")], DOCS))
    assert only == brute([(1, "the quick fox")]) and only[0][6] == 1.0


def test_rows_of_one_id_and_without_id_are_all_kept(spark):
    rows = [(1, f"the text number {k} of one id") for k in range(5)] + [(None, f"the text {k} without an id") for k in range(5)] + [(2, "the same")] * 4
    out = spots.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 14
    assert len({r.fingerprint for r in out if r.doc_id == 2}) == 1
    assert sorted(r.near_next for r in out if r.doc_id == 2) == [0.0, 1.0, 1.0, 1.0]


def test_no_python_runs(spark):
    plan = spots.digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_time_is_linear_in_a_long_text(spark):
    import time

    def seconds(n, word):
        df = spark.createDataFrame([(1, word * n)], DOCS)
        began = time.time()
        df.select(F.size(spots.spot_set(F.col("text")))).collect()
        return time.time() - began

    for word in ("the ", "1 ", "cat the ", "<"):
        seconds(1000, word)
        assert seconds(400_000, word) < 6 * seconds(100_000, word) + 2


def brute_classes(rows, percent):
    sets = [(i, frozenset(brute_spots(t or ""))) for i, t in rows]
    reach = {k: k for k in range(len(sets))}

    def top(k):
        while reach[k] != k:
            k = reach[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                reach[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_classes_equal_brute_force_in_hot_groups(spark):
    import random

    rng = random.Random(9)
    words = ["the", "of", "and", "to", *[f"w{k}ord" for k in range(60)]]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(900 - k, " ".join(base[: 117 + k % 4] + [f"end{k}", f"tail{k}"])) for k in range(70)]  # near copies of one text
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    rows += [(2000 + k, "the common line of all " + " ".join(f"own{k}x{j} of" for j in range(k % 5))) for k in range(40)]
    rows += [(None, " ".join(base)), (None, "the lone one walks"), (7, None), (8, ""), (9, "..."), (10, "x"), (10, "x"), (11, "x")]
    df = spark.createDataFrame(rows, DOCS)
    for percent in (80, 60):
        assert sorted((tuple(r) for r in spots.classes(df, percent).collect()), key=str) == brute_classes(rows, percent)
    assert spots.classes(spark.createDataFrame([], DOCS)).count() == 0
    plan = spots.classes(df.limit(5))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classes_move_no_whole_sets_to_find_rows(spark, monkeypatch):
    """Sets are of 32-bit integers, equal exactly where the signatures are; rows meet their set by its hashes."""
    wrote, staged = {}, spots.staged
    monkeypatch.setattr(spots, "staged", lambda df, name: wrote.setdefault(name, staged(df, name)))
    df = spark.createDataFrame([(k, f"the cat{k % 3} sat on the mat{k % 2}") for k in range(12)], DOCS)
    out = spots.classes(df)
    assert wrote["sets"].schema["spots"].dataType.elementType.simpleString() == "int"
    assert "spots:array" not in out._jdf.queryExecution().executedPlan().toString()
    hexes = ["00000000", "7fffffff", "80000000", "ffffffff", "0000000a"]
    ints = spark.range(1).select(spots.as_ints(F.array(*[F.lit(x) for x in hexes])).alias("x")).first()["x"]
    assert ints == [int(x, 16) - 2**31 for x in hexes]
