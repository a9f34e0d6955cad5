"""Vector cells, kept postings, rule scopes, symbols, document chunks and rerankers against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import chunking, embed, ignores, lexical, postings, rerank, symbols, vectors
from skein.operators.cells import Cells
from skein.operators.postings import Postings
from skein.plans import index as plans
from skein.plans import reference
from skein.sources import scan, store

SF = "/root/testdata/sf0.01"


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


HITS = ("query_id", "rank", "chunk_id", "distance")


def clustered(spark, n=3000, dim=12, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    x = centres[np.arange(n) % groups] + rng.normal(size=(n, dim)) / 4
    rows = [(int(i), [float(v) for v in x[i]], f"f{i % 50}", int(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, file_path string, label int"), x


def test_cells_certain_search_is_exact_and_opens_few(spark, tmp_path):
    df, _ = clustered(spark)
    odd = spark.createDataFrame([(9001, None, "x", 0), (9002, [1.0, None], "x", 0), (9003, [1.0], "x", 0), (9004, [0.0] * 12, "x", 0)], df.schema)
    df = df.unionByName(odd)
    index = Cells(store.Store(spark, f"file://{tmp_path}"), "v")
    index.build(df, 48)
    q = df.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(-1, None), (-2, [1.0])], "query_id long, embedding array<double>"))
    few = q.where("query_id = 300")
    assert tuples(index.search(q, 8, certain=True), *HITS) == tuples(vectors.vector_topk(df, q, 8), *HITS)
    assert tuples(index.search(few, 8, probes=1, certain=True), *HITS) == tuples(vectors.vector_topk(df, few, 8), *HITS) and index.opened <= 12
    own = df.where("label = 3")
    assert tuples(index.search(q, 5, where="label = 3", certain=True), *HITS) == tuples(vectors.vector_topk(own, q, 5), *HITS)
    assert index.search(q.where("query_id = -1"), 5).count() == 0


def test_cells_follow_changed_files(spark, tmp_path):
    df, x = clustered(spark, 1200)
    s = store.Store(spark, f"file://{tmp_path}")
    index = Cells(s, "v")
    index.build(df, 24)
    rows = [(5001, [float(v) for v in x[3] + 0.01], "f3", 1), (5002, [float(v) for v in -9 * x[8]], "f3", 1)]
    new = spark.createDataFrame(rows, df.schema)
    before = s._entry("v", "cells")["parts"]
    touched = index.replace_files(spark.createDataFrame([("f3",)], "file_path string"), new)
    after = s._entry("v", "cells")["parts"]
    assert {int(k) for k in after if after[k] != before.get(k)} <= touched and 0 < len(touched) < 24
    now = df.where("file_path <> 'f3'").unionByName(new)
    q = now.where("chunk_id % 60 = 0 OR chunk_id > 5000").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert tuples(index.search(q, 6, certain=True), *HITS) == tuples(vectors.vector_topk(now, q, 6), *HITS)


def test_probes_reach_their_recall(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "chunk_id")
    for name, df in (("tables", v), ("groups", clustered(spark, 4000)[0])):
        index = Cells(store.Store(spark, f"file://{tmp_path}/{name}"), "v")
        index.build(df)
        q = df.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
        exact = set(tuples(vectors.vector_topk(df, q, 8), "query_id", "chunk_id"))
        found = set(tuples(index.search(q, 8), "query_id", "chunk_id"))
        assert len(exact & found) >= 0.9 * len(exact)
        if name == "groups":
            assert index.tuned(8) <= 6


CHUNK = "chunk_id string, file_path string, name string, parent string, language string, source string, ordinal long"


def test_postings_equal_a_scan_and_skip_blocks(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("load", "save", "find") for b in ("_user", "_file", "row", "x") for c in ("", "_all", "2")]
    rows = [(f"d{k % 40}/f{k}.py:{k}", f"d{k % 40}/f{k}.py", rng.choice(words), rng.choice([None, "Store"]), "python", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), k) for k in range(1500)]
    rows += [("z/rare.py:1", "z/rare.py", "needle_in_hay", None, "python", "needle needle needle in hay", 9000), ("z/none.py:1", "z/none.py", None, None, None, None, 9001)]
    s = store.Store(spark, f"file://{tmp_path}", buckets=4)
    df = spark.createDataFrame(rows, CHUNK)
    s.write("c", df)
    own = Postings(s, "c")
    own.build()
    asked = spark.createDataFrame([("a", "needle_in_hay needle"), ("b", "load_user save"), ("c", "zzz qq"), ("d", "py"), ("e", "the"), ("f", "x2 ro")], "query_id string, question string")
    cols = ("query_id", "rank", "chunk_id", "score")
    assert tuples(own.topk(asked, 5), *cols) == tuples(lexical.lexical_topk(df, asked, 5), *cols)
    assert tuples(own.topk(asked.where("query_id = 'a'"), 1), *cols) == tuples(lexical.lexical_topk(df, asked.where("query_id = 'a'"), 1), *cols)
    assert own.read_blocks <= 3 < 20 <= own.all_blocks
    new = spark.createDataFrame([("d1/f1.py:n", "d1/f1.py", "needle_in_hay", "needle", "python", "needle_in_hay " * 9, 1)], CHUNK)
    gone = spark.createDataFrame([("d1/f1.py",), ("z/rare.py",)], "file_path string")
    change = s.change("c")
    own.refresh(change, change.replace_files(gone, new))
    change.commit()
    now = s.read("c")
    assert tuples(own.topk(asked, 5), *cols) == tuples(lexical.lexical_topk(now, asked, 5), *cols)


def test_pieces_of_a_keyword():
    assert postings.pieces("ab") == ["ab"] and postings.pieces("abc") == ["abc"] and postings.pieces("abcda") == ["abc", "bcd", "cda"]


def test_scores_of_many_keywords_go_in_slices(spark, monkeypatch):
    df = spark.createDataFrame([(str(k), f"p{k}.py", f"n{k}", None, "python", f"alpha{k % 5} beta{k % 7} gamma", k) for k in range(300)], CHUNK)
    asked = spark.createDataFrame([(str(k), f"alpha{k} beta{k % 7} n{k}") for k in range(40)], "query_id string, question string")
    whole = tuples(lexical.lexical_topk(df, asked, 4), "query_id", "rank", "chunk_id", "score")
    monkeypatch.setattr(lexical, "CELLS", 50)  # less than a row of keywords: a chunk at a time
    assert tuples(lexical.lexical_topk(df, asked, 4), "query_id", "rank", "chunk_id", "score") == whole


def brute_ignored(path, files):
    """As the scan judges: rules top down, folders above first."""
    def rules_for(p):
        r, parts = scan.Rules(), p.split("/")[:-1]
        for k in range(len(parts) + 1):
            folder = "/".join(parts[:k])
            if folder in files:
                r.load(folder, files[folder])
        return r

    parts = path.split("/")
    for k in range(1, len(parts)):
        above = "/".join(parts[:k])
        if rules_for(above).ignored(above, True):
            return True
    return rules_for(path).ignored(path, False)


def test_rule_scopes_judge_as_the_scan_does(spark):
    files = {
        "": "*.log\n!keep.log\nbuild/\n/top.txt\n# comment\n\n**/tmp/*.bin\ndocs/**/draft?.md\n[ab]*.dat\n  \nsrc/*.c\na.b+c\n",
        "src": "!x.log\ngen/\n*.o\n!main.o\n", "src/deep": "*\n!*.py\n", "docs": "!draft1.md\n/only\n",
    }
    names = ["x.log", "keep.log", "top.txt", "main.o", "other.o", "a.dat", "c.dat", "draft1.md", "draftX.md", "f.py", "y.bin", "m.c", "only", "a.b+c", "aXb+c", "build"]
    folders = ["", "build", "src", "src/gen", "src/deep", "src/deep/er", "docs", "docs/x", "docs/x/y", "tmp", "lib/tmp", "lib/build/in", "other/src"]
    paths = [f"{d}/{n}".lstrip("/") for d in folders for n in names]
    df = spark.createDataFrame([(p,) for p in [*paths, *paths[:3], None, ""]], "path string")
    rules = spark.createDataFrame([*files.items(), ("lib", None)], "folder string, content string")
    got = {r["path"]: r["ignored"] for r in ignores.ignored(df, rules).collect()}
    assert got == {p: brute_ignored(p, files) for p in paths}
    assert 20 < sum(got.values()) < len(got) - 20
    assert not any(r["ignored"] for r in ignores.ignored(df, rules.limit(0)).collect())
    told = {r["ignored"] for r in reference.ignored_paths(spark, SF).collect()}
    assert told == {True, False}


def test_innermost_class_of_every_function(spark):
    rng = random.Random(6)
    rows = []
    for f in range(5):
        for k in range(60):
            a = rng.randrange(1, 900)
            rows.append((f"f{f}", rng.choice(["class", "function", "function"]), f"n{k}", a, a + rng.choice([-1, 0, 3, 40, 500])))
    rows += [("f0", "function", "n", None, 3), ("f9", "class", "Long", 1, 100_000), ("f9", "function", "at_end", 99_999, 100_000)]
    df = spark.createDataFrame(rows, "file_path string, kind string, name string, start_line int, end_line int")
    want = set()
    for f, kind, n, a, z in rows:
        if kind == "function":
            held = [(s, -e, m) for g, k, m, s, e in rows if g == f and k == "class" and a is not None and s <= a <= z <= e]
            best = max(held, default=None)
            want.add((f, n, a, z, best and best[2], best and best[0]))
    got = symbols.members(df)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {tuple(r)[:3] + (r["methods"],) for r in symbols.class_sizes(df).collect()} == {(f, c, s, sum(1 for w in want if w[0] == f and w[4:] == (c, s))) for f, _, _, _, c, s in want if c}


DOCS = [
    "", "one line", "a\n", "\n\n", "# A\ntext\n## B\nmore\n", "no heading\n" * 30, "# A\n" + "word " * 40 + "\n" + "x\n" * 30 + "   \n# B\n\n\n" + "z" * 400 + "\ny\n  ", "#not\n# yes\n#\tTab\n####### seven\n",
    "## only\n" + "many words here\n" * 40, "é ü 漢字 _x_ a-b\n" * 20, "# A\r\ntext\r\n# B\r\n" + "t t t\r\n" * 20,
]


def test_documents_are_chunked_as_by_the_plain_version(spark):
    rows = [(f"d{k}.md", "doc", "h", t) for k, t in enumerate(DOCS)]
    files = spark.createDataFrame(rows, "rel_path string, language string, file_hash string, content string")
    for most in (5, 20, 512):
        got = {}
        for r in chunking.doc_chunks(files, most).orderBy("ordinal").collect():
            got.setdefault(r["file_path"], []).append({k: r[k] for k in ("name", "start_line", "end_line", "source", "token_count", "metadata")})
        for path, _, _, text in rows:
            want = [{k: c[k] for k in ("name", "start_line", "end_line", "source", "token_count", "metadata")} for c in chunking.chunks_of(text, "doc", path, most)]
            assert got.get(path, []) == want, (path, most)
    plan = chunking.doc_chunks(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    both = files.unionByName(spark.createDataFrame([("a.py", "python", "h", "def f():\n    return 1\n"), ("n.md", "doc", "h", None)], files.schema))
    assert chunking.chunk_files(both).where("language = 'python'").count() == 2


def test_rerankers_compose(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.6, 0.8]), (4, [0.0, 1.0]), (5, None)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.1]), ("r", [0.0, 1.0]), ("n", None)], "query_id string, embedding array<double>")
    hits = spark.createDataFrame([(i, k, n + 1) for i in ("q", "r", "n") for n, k in enumerate((1, 2, 3, 4, 5))], "query_id string, chunk_id long, rank int")
    got = hits.transform(rerank.diverse(v, q, 3, 0.5))
    by = {i: [r["chunk_id"] for r in sorted(got.where(F.col("query_id") == i).collect(), key=lambda r: r["rank"])] for i in ("q", "r", "n")}
    assert by["q"][0] in (1, 2) and {1, 2} - set(by["q"][:2]) and by["r"][0] == 4 and not by["n"]
    near = hits.transform(rerank.diverse(v, q, 3, 1.0)).where("query_id = 'r'").orderBy("rank")
    assert [r["chunk_id"] for r in near.collect()] == [4, 3, 2]
    again = hits.withColumn("votes", F.col("chunk_id") % 3).transform(rerank.by_score("votes", 2)).where("query_id = 'q'").orderBy("rank")
    assert [r["chunk_id"] for r in again.collect()] == [2, 5]
    with pytest.raises(ValueError):
        rerank.diverse(v, q, 0)


def test_search_takes_a_reranker_and_one_failed_channel(spark):
    rows = [(str(k), f"s/f{k}.py", f"name{k}", None, "python", f"alpha beta{k} " + "gamma " * (k % 3), [float(k % 5), 1.0, 0.0], 1, 2, "function") for k in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, name string, parent string, language string, source string, embedding array<double>, start_line int, end_line int, chunk_type string")
    asked = spark.createDataFrame([("q", "alpha gamma name7")], "query_id string, question string")
    hits = plans.search(chunks, asked, "lexical", 4, rerank=rerank.by_score("score", 4))
    assert tuples(hits, "rank", "chunk_id") == tuples(plans.search(chunks, asked, "lexical", 4), "rank", "chunk_id")
    none = lambda asked, n: spark.createDataFrame([], "query_id string, chunk_id string, distance double, rank int")
    only = plans.search(chunks, asked, "hybrid", 4, near=none)
    assert [r["chunk_id"] for r in only.orderBy("rank").collect()] == [r["chunk_id"] for r in plans.search(chunks, asked, "lexical", 4).orderBy("rank").collect()]
    assert {r["channels"] for r in only.collect()} == {"lexical"}

    def broken(texts):
        raise OSError("no model")

    embed.register(embed.Profile("broken", 3), lambda: broken)
    with pytest.warns(UserWarning, match="vector channel failed"):
        left = plans.search(chunks, asked, "hybrid", 4, "broken", tolerant=True)
    assert tuples(left, "rank", "chunk_id") == tuples(only, "rank", "chunk_id")
    with pytest.raises(Exception, match="no model"):
        plans.search(chunks, asked, "hybrid", 4, "broken").collect()
    with pytest.warns(UserWarning), pytest.raises(Exception):  # both fail
        plans.search(chunks, asked, "hybrid", 4, "broken", words=lambda a, n: lexical.lexical_topk(chunks.drop("source"), a, n), tolerant=True).collect()


def test_agents_of_many_tasks_and_tables_as_sources(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", "import os\nX = 1\nY = 2\n\n\ndef alpha_run():\n    return 1\n"), ("b.md", "doc", "# Beta\n\nguide to alpha_run"), ("c.md", "doc", "API_KEY=1"), ("d.bin", None, "x"), ("e.md", "doc", None), ("b.md", "doc", "# Beta\n\nguide to alpha_run")], "rel_path string, language string, content string")
    s = store.Store(spark, f"file://{tmp_path}", buckets=4)
    first = plans.index_table(files, s, "t", "letters")
    assert (first["added"], first["chunks"]) == (2, 3) and "chunks" not in plans.index_table(files, s, "t", "letters")
    tasks = spark.createDataFrame([(1, "alpha_run. what is beta?"), (2, "zzz qqq")], "task_id long, task string")
    steps, evidence, briefs = plans.run_agents(s.read("t"), tasks, "lexical", "letters", 3)
    told = {r["task_id"]: (r["key_files"], r["insufficient_evidence"]) for r in briefs.collect()}
    assert set(told[1][0]) == {"a.py", "b.md"} and not told[1][1] and told[2] == ([], True)
    assert steps.where("task_id = 1").count() == 3 and evidence.select("task_id").distinct().count() == 1
