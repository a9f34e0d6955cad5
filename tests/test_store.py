"""The store: commits of several tables, lost writers, statistics, lookups, folder hashes, shared vectors, the stream."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import embed
from skein.operators.postings import Postings
from skein.plans import index as plans
from skein.sources import store
from skein.sources.folders import FolderTracker, folder_hashes
from skein.streaming import incremental
from tests.test_reference import write

ROWS = "chunk_id string, file_path string, chunk_type string, ordinal long"


def rows(spark, *x):
    return spark.createDataFrame(x, ROWS)


def state(s):
    return {t: sorted(tuple(r) for r in s.read("c", t).collect()) for t in ("chunks", "tracker", "manifest")}


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}", buckets=4)
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    change = s.change("c")
    change.write(rows(spark, ("a:1", "a", "doc", 0)))
    change.write(one(1), "tracker")
    change.write(one(1), "manifest")
    assert s.read("c") is None  # not yet
    change.commit()
    before = state(s)
    for broken in range(3):  # a run that dies after so many of its steps
        change = s.change("c")
        steps = [lambda c=change: c.replace_files(spark.createDataFrame([("a",)], "file_path string"), rows(spark, ("a:2", "a", "doc", 0))), lambda c=change: c.write(one(2), "tracker"), lambda c=change: c.write(one(2), "manifest")]
        for step in steps[: broken + 1]:
            step()
        assert state(s) == before
    with monkeypatch.context() as m:  # or before the pointer is written

        def fail(*a):
            raise OSError("disk full")

        m.setattr(store.Store, "_point", fail)
        with pytest.raises(OSError, match="disk full"):
            s.write("c", one(3), "tracker")
    assert state(s) == before and s.vacuum("c") > 0 and state(s) == before
    s.write("c", one(3), "tracker")
    assert state(s)["tracker"] == [(3,)] and state(s)["chunks"] == before["chunks"]


def test_lost_and_concurrent_writers(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=4)
    s.write("c", rows(spark, ("a:1", "a", "doc", 0)))
    (tmp_path / "c" / "pointer" / "000000000002.json").write_text("")
    (tmp_path / "c" / "pointer" / ".000000000003-x").write_text("half of")
    for n in range(2):
        s.write("c", rows(spark, (f"b:{n}", "b", "doc", 0)))
    assert [r["chunk_id"] for r in s.read("c").collect()] == ["b:1"]
    first, second = s.change("c"), s.change("c")
    first.write(rows(spark, ("x:1", "x", "doc", 0)), "other")
    second.write(rows(spark, ("y:1", "y", "doc", 0)))
    second.commit()
    with pytest.raises(store.ConcurrentWrite):
        first.commit()
    assert [r["chunk_id"] for r in s.read("c").collect()] == ["y:1"] and s.read("c", "other") is None


def test_statistics_follow_changes_and_read_no_chunks(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=8)
    own = spark.range(6000).selectExpr("concat('f', id % 3000, ':', id) AS chunk_id", "concat('f', id % 3000) AS file_path", "if(id % 3 = 0, 'doc', 'function') AS chunk_type", "id AS ordinal")
    s.write("c", own)
    gone = spark.range(0, 500).selectExpr("concat('f', id) AS file_path")
    s.replace_files("c", gone, rows(spark, ("f1:x", "f1", "class", 1)))
    exact = {r["chunk_type"]: (r["n"], r["d"]) for r in s.read("c").groupBy("chunk_type").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("d")).collect()}
    told = s.statistics("c", "chunk_type")
    assert {r["chunk_type"]: r["n"] for r in told.collect()} == {k: n for k, (n, _) in exact.items()} == {r["chunk_type"]: r["n"] for r in store.stats(s.read("c")).collect()}
    assert all(abs(r["files"] - exact[r["chunk_type"]][1]) <= 0.05 * exact[r["chunk_type"]][1] + 1 for r in told.collect())
    whole = s.statistics("c").first()
    assert whole["n"] == 5001 and abs(whole["files"] - 2501) < 125
    assert "/chunks/" not in "".join(told.inputFiles())
    assert s.statistics("none").first()["n"] == 0


def test_lookup_opens_only_the_buckets_of_the_ids(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=16)
    s.write("c", spark.range(2000).selectExpr("concat('src/f', id, ':', id) AS chunk_id", "concat('src/f', id) AS file_path", "'doc' AS chunk_type", "id AS ordinal"))
    ids = spark.createDataFrame([("src/f7:7", 1), ("src/f7:8", 2), ("src/f9:9", 3)], "chunk_id string, q int")
    got = s.lookup("c", ids, "file_path", "ordinal")
    assert sorted(tuple(r) for r in got.collect()) == [("src/f7:7", 1, "src/f7", 7), ("src/f9:9", 3, "src/f9", 9)]
    opened = {f.rsplit("_part=", 1)[1].split("/")[0] for f in got.inputFiles() if "_part=" in f}
    assert 1 <= len(opened) <= 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "chunk_type" not in plan.split("ReadSchema: struct<")[-1].split(">")[0]


def test_folder_hashes_equal_the_full_comparison(spark, tmp_path):
    rng = random.Random(2)
    old = {f"{rng.choice('abc')}/{rng.randrange(8)}/{rng.randrange(40)}.py": str(k) for k in range(700)} | {"top.md": "1", "a/one.md": "2"}
    s = store.Store(spark, f"file://{tmp_path}")
    df = lambda x: spark.createDataFrame([*x.items()], "rel_path string, file_hash string")
    tracker = FolderTracker(s, "c", 16)
    assert tracker.change_set(df(old)).count() == len(old)  # nothing stored yet
    tracker.write(df(old))
    assert tracker.change_set(df(old)).count() == 0 and tracker.opened == 0
    for edit in ({"a/1/new.py": "n"}, {"b/2/deep/er/x.py": "n", "top.md": "9"}, {k: None for k in old if k.startswith("c/3/")}):
        new = {k: v for k, v in (old | edit).items() if v is not None}
        want = sorted(tuple(r) for r in store.change_set(df(new), df(old)).collect())
        assert want and sorted(tuple(r) for r in tracker.change_set(df(new)).collect()) == want
        assert tracker.opened <= 5
    tree = {r["folder"]: r["files"] for r in folder_hashes(df(old)).collect()}
    assert tree[""] == len(old) and tree["a"] == sum(k.startswith("a/") for k in old)
    assert folder_hashes(df({"x": "1"})).count() == 1
    assert tracker.change_set(spark.createDataFrame([], "rel_path string, file_hash string")).where("status = 'deleted'").count() == len(old)


def test_texts_are_embedded_once_for_all_collections(spark, tmp_path):
    s, told = store.Store(spark, f"file://{tmp_path}/s"), str(tmp_path / "told")

    def load():
        def encode(texts):
            with open(told, "a") as f:
                f.write("x" * len(texts))
            return np.array([[len(t), 1.0, t.count("e")] for t in texts])

        return encode

    embed.register(embed.Profile("counted", 3), load)
    own = embed.SharedEmbeddings(s, 4)
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "chunk_id long, source string")
    got = {r["chunk_id"]: r["embedding"] for r in own.of(first, "counted").collect()}
    assert os.path.getsize(told) == 3 and got[1] == got[3] and len(got) == 4
    again = spark.createDataFrame([(9, "two"), (10, "three")], "chunk_id long, source string")
    assert own.of(again, "counted").count() == 2 and os.path.getsize(told) == 4
    assert own.add(again, "counted") == 0 and os.path.getsize(told) == 4
    assert own.add(again, "letters") == 2  # another profile has vectors of its own


def test_a_second_index_of_the_same_texts_and_kept_postings(spark, tmp_path):
    files = {"src/a.py": "def alpha_handler():\n    return 1\n", "docs/b.md": "# Title\n\nthe beta guide\n", "docs/c.md": "gamma notes"}
    write(tmp_path / "one", files)
    write(tmp_path / "two", files)
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    first = plans.index(spark, str(tmp_path / "one"), s, keep_postings=True)
    vectors = s.read(embed.SHARED, "vectors").count()
    plans.index(spark, str(tmp_path / "two"), s)
    assert s.read(embed.SHARED, "vectors").count() == vectors
    name = first["collection"]
    asked = spark.createDataFrame([("q", "where is alpha_handler"), ("r", "delta notes"), ("n", "the")], "query_id string, question string")
    for step in range(2):
        for mode in ("vector", "lexical", "hybrid"):
            key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9), r["source"]) for r in df.collect())
            assert key(plans.search_stored(s, name, asked, mode, 3)) == key(plans.search(s.read(name), asked, mode, 3))
        write(tmp_path / "one", {"docs/d.md": "delta delta notes", "src/a.py": "def other():\n    return 2\n"})
        plans.index(spark, str(tmp_path / "one"), s)
    assert Postings(s, name).topk(asked.where("query_id = 'r'"), 3).orderBy("rank").first()["chunk_id"].startswith("docs/d.md:")


def test_the_stream_keeps_an_indexed_collection(spark, tmp_path):
    write(tmp_path / "r", {"a.md": "alpha", "b.md": "beta"})
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    name = plans.index(spark, str(tmp_path / "r"), s)["collection"]
    dimension = len(s.read(name).first()["embedding"])

    def arrive(n, *files):
        spark.createDataFrame(files, incremental.FILES).write.parquet(str(tmp_path / "in" / str(n)))
        os.makedirs(tmp_path / "all", exist_ok=True)
        for f in os.listdir(tmp_path / "in" / str(n)):
            if f.endswith(".parquet"):
                os.rename(tmp_path / "in" / str(n) / f, tmp_path / "all" / f"{n}-{f}")
        q = incremental.upsert_stream(spark, str(tmp_path / "all"), s, name, str(tmp_path / "check"))
        q.awaitTermination(120)
        assert q.exception() is None

    arrive(1, ("a.md", "doc", "h2", "alpha anew"), ("new.py", "python", "h3", "def f():\n    return 1\n"))
    got = {r["source"]: len(r["embedding"]) for r in s.read(name).collect()}
    assert {"alpha anew", "beta"} <= set(got) and "alpha" not in got and set(got.values()) == {dimension}
    assert {r["rel_path"]: r["file_hash"] for r in s.read(name, "tracker").where("rel_path <> 'b.md'").collect()} == {"a.md": "h2", "new.py": "h3"}
    before = sorted(r["chunk_id"] for r in s.read(name).collect())
    arrive(2, ("a.md", "doc", "h2", "alpha anew"))
    assert sorted(r["chunk_id"] for r in s.read(name).collect()) == before
