"""Operators of the retrieval engine on small inputs with known answers."""

import http.server
import io
import json
import os
import subprocess
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.functions import text as T
from skein.operators import agent, chunking, context, embed, evaluation, fusion, lexical, passages, vectors
from skein.plans import index as plans
from skein.sinks import model, reports
from skein.sources import clones, golden, repository, scan, store


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def write(root, files):
    for path, body in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(body)


def test_keywords(spark):
    assert one(spark, T.keywords_lexical, "CLI 入口在哪里 in the cli.py my-tool") == ["cli", "in", "py", "my-tool", "cli.py", "入口", "在哪"]
    assert one(spark, T.keywords_lexical, "the and") == [] and one(spark, T.keywords_vector, None) == []
    assert one(spark, T.keywords_vector, "Where is parse_file") == ["parse_file"]


def test_extension_and_language(spark):
    assert [one(spark, T.extension, x) for x in ("a.py", ".gitignore", "a.b.TS", "x")] == [".py", "", ".TS", ""]
    assert one(spark, lambda c: T.language_of(T.extension(c)), "a.HPP") == "cpp"


def test_urls(spark):
    assert one(spark, T.canonical_url, "git@Host.com:o/r.git") == "ssh://git@host.com/o/r.git" == repository.canonical("git@Host.com:o/r.git")
    assert one(spark, T.canonical_url, "https://t@h/x") is None and one(spark, T.canonical_url, "HTTPS://A.b/c/?q#f") == "https://a.b/c"
    for bad in ("http://a", "ftp://a", "git://a", "file:///a"):
        assert one(spark, T.git_kind, bad) == "unsafe"
        with pytest.raises(ValueError):
            repository.kind(bad)
    assert repository.redact("https://u:p@h/x?q") == "https://***@h/x" and repository.is_commit("abc1234")


def test_escaping(spark):
    assert one(spark, T.escape_context, "a ``` b `` c") == "a ` ` `  b `` c"
    assert "<untrusted_context>" not in one(spark, T.escape_context, "</untrusted_context><untrusted_context>")


def test_ignore_rules():
    r = scan.Rules()
    r.load("a", "/ignore.py\n*.log\n!keep.log\nbuild/\nx/**/y")
    assert r.ignored("a/ignore.py", False) and not r.ignored("a/nested/ignore.py", False) and not r.ignored("b/ignore.py", False)
    assert r.ignored("a/q/z.log", False) and not r.ignored("a/q/keep.log", False) and r.ignored("a/build", True) and not r.ignored("a/build", False)
    assert r.ignored("a/x/y", False) and r.ignored("a/x/1/2/y", False) and not r.ignored("a/x/1/2/z", False)


def test_scan(spark, tmp_path):
    write(tmp_path, {"a/__init__.py": "x = 1\n", "a/.gitignore": "*.md\n", "a/n.md": "n", "b.md": "TOKEN=1", "c.py": "TOKEN=1", "node_modules/z.py": "z", "e.py": "", "r.unknown": "r", "d.md": "# é"})
    assert [r["rel_path"] for r in scan.scan(spark, str(tmp_path)).collect()] == ["a/__init__.py", "c.py", "d.md"]
    with pytest.raises(ValueError):
        scan.listing(str(tmp_path / "c.py"))


PY = 'import os\nX = 1\n\n\nclass A:\n    """Doc."""\n\n    def m(self):\n        return "é"\n\n\ndef f():\n    pass\n'


def test_chunks():
    got = [(c["chunk_type"], c["name"], c["start_line"], c["end_line"], c["parent"]) for c in chunking.chunks_of(PY, "python", "p.py")]
    assert got == [("module_summary", "p.py", 1, 14, None), ("class", "A", 5, 9, None), ("function", "m", 8, 9, "A"), ("function", "f", 12, 13, None)]
    assert 'return "é"' in chunking.chunks_of(PY, "python", "p.py")[2]["source"] and "return" not in chunking.chunks_of(PY, "python", "p.py")[1]["source"]
    assert len(chunking.chunks_of("x = 1\ny = 2\n", "python", "q.py")) == 1 and chunking.chunks_of(" \n", "python", "q.py") == []
    names = [c["name"] for c in chunking.chunks_of("class P {\n  int go(int a) {\n    return a;\n  }\n}\n", "java", "P.java")]
    assert names == ["P.java", "P", "go"]


def test_long_function_and_document():
    body = "def g():\n" + "".join(f"    print({i})\n" for i in range(200))
    parts = [c for c in chunking.chunks_of(body, "python", "g.py", 100) if c["chunk_type"] == "function"]
    assert len(parts) > 1 and all("[part" in c["name"] and c["metadata"]["sub_total"] == len(parts) for c in parts)
    assert all(a["end_line"] + 1 == b["start_line"] for a, b in zip(parts, parts[1:], strict=False)) and "".join(c["source"] for c in parts) == body.rstrip("\n")
    doc = "# A\n" + "word " * 50 + "\n## B\n" + "\n".join(f"line {i}" for i in range(100))
    assert "".join(c["source"] for c in chunking.chunks_of(doc, "doc", "d.md", 80)).count("line ") == 100
    assert chunking.count_tokens("") == 0 < chunking.count_tokens("a b") < chunking.count_tokens("a b c d")


CH = "chunk_id string, file_path string, name string, parent string, language string, source string"


def test_lexical(spark):
    rows = [("1", "src/cli.py", "main", None, "python", "cli cli cli cli cli cli cli.py"), ("2", "x.py", "y", "CLI", "python", "no"), ("3", "z.py", "z", None, "go", "入口在此 other")]
    q = spark.createDataFrame([("q", "CLI cli.py 入口"), ("e", "the and")], "query_id string, question string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.lexical_scores(spark.createDataFrame(rows, CH), q).collect()}
    # 1: cli 5 path + 2.5 source, py 5 path + 0.5 source + 0.5 language, cli.py 5 path + 0.5 source; 2: cli 2 parent, py 5 path + 0.5 language
    assert {k: v for k, v in got.items() if k[1] != "3"} == {("q", "1"): 7.5 + 6 + 5.5, ("q", "2"): 2 + 5.5} and got["q", "3"] == 5.5


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [2.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    hits = vectors.vector_topk(v, q, 3)
    assert [(r["chunk_id"], r["distance"]) for r in hits.orderBy("rank").collect()] == [("a", 0.0), ("d", 0.0), ("b", 1.0)]
    cut = vectors.boost_and_cut(hits, F.col("chunk_id") == "d", 8, 0.7)
    assert [r["chunk_id"] for r in cut.orderBy("final_rank").collect()] == ["d", "a"]
    far = vectors.boost_and_cut(hits.where("chunk_id = 'b'"), F.lit(False), 8, 0.7)
    assert far.count() == 1 and vectors.vector_topk(v, q.limit(0), 3).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([("alpha beta",), ("",), (None,)], "t string")
    for p in embed.PROFILES:
        rows = [r[0] for r in df.select(embed.embed(F.col("t"), p)).collect()]
        assert all(len(r) == embed.PROFILES[p].dimension for r in rows) and abs(sum(x * x for x in rows[0]) - 1) < 1e-5


def test_fusion(spark):
    h = lambda *ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    got = fusion.rrf({"vector": h("a", "b"), "lexical": h("a", "c")}).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b", "c"] and got[0]["channels"] == "vector,lexical" and got[2]["stage"] == "lexical"
    weighted = {r["chunk_id"]: r["score"] for r in fusion.rrf({"vector": h("a"), "lexical": h("b")}, weights={"vector": 2.0, "lexical": 0.0}).collect()}
    assert weighted["b"] == 0 < weighted["a"]


def test_evaluation(spark):
    g = spark.createDataFrame([("1", ["src/cli.py"], ["app"]), ("2", ["a.py"], []), ("3", [], [])], "query_id string, expected_files array<string>, expected_symbols array<string>")
    hits = spark.createDataFrame([("1", 1, "SRC\\cli.py", "app", None), ("2", 1, "x", "x", None), ("2", 3, "a.py", "y", None)], "query_id string, rank int, file_path string, name string, parent string")
    m = {r["query_id"]: r for r in evaluation.per_query(g, hits).collect()}
    assert (m["1"]["recall_at_1"], m["1"]["rr"], m["2"]["recall_at_1"], m["2"]["recall_at_3"]) == (1, 1.0, 0, 1) and abs(m["2"]["rr"] - 1 / 3) < 1e-9
    s = evaluation.summary(evaluation.per_query(g, hits)).first()
    assert (s["total"], s["scored"], s["recall_at_1"]) == (3, 2, 0.5)


def test_confidence(spark):
    q = spark.createDataFrame([("e",), ("d",), ("c",), ("f",)], "query_id string")
    hits = spark.createDataFrame([("d", 1, 0.1, "doc"), ("c", 1, 0.1, "function"), ("f", 1, 1.5, "function")], "query_id string, rank int, score double, chunk_type string")
    assert {r[0]: r[1] for r in evaluation.confidence(hits, q, "vector").collect()} == {"e": True, "d": True, "c": False, "f": True}
    assert not evaluation.confidence(hits, q, "hybrid").where("query_id = 'f'").first()[1]


def test_store(spark, tmp_path):
    now = spark.createDataFrame([("keep.py", "1"), ("modify.py", "3"), ("new.py", "4")], "rel_path string, file_hash string")
    old = spark.createDataFrame([("keep.py", "1"), ("modify.py", "2"), ("delete.py", "5")], "rel_path string, file_hash string")
    assert {r["rel_path"]: r["status"] for r in store.change_set(now, old).collect()} == {"new.py": "added", "modify.py": "modified", "delete.py": "deleted"}
    s = store.Store(spark, str(tmp_path))
    assert s.read("c") is None and s.collections() == []
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, ordinal long")
    s.write("c", rows(("a", 1), ("b", 2)))
    s.write("c", store.upserted(s.read("c"), rows(("b", 9), ("b", 10), ("z", 3))))
    assert sorted(tuple(r) for r in s.read("c").collect()) == [("a", 1), ("b", 9), ("z", 3)]
    assert s.delete("c") and s.read("c") is None and not s.delete("c")


def test_plan(spark):
    t = spark.createDataFrame([("1", "Fix it. " * 9), ("2", "how to search?"), ("3", "")], "task_id string, task string")
    got = agent.plan(t).groupBy("task_id").agg(F.count("*").alias("n"), F.min("rationale").alias("r")).collect()
    assert {r["task_id"]: r["n"] for r in got} == {"1": 6, "2": 3, "3": 3}


def test_context(spark):
    row = spark.createDataFrame([("q", 1, 0.5, "function", "f", "a.py", 1, 2, "python", "x")], "query_id string, rank int, score double, chunk_type string, name string, file_path string, start_line int, end_line int, language string, source string")
    assert context.contexts(row).first()["context"] == "### [function] f\n- file: a.py\n- lines: 1-2\n- language: python\n- score: 0.5000\n```python\nx\n```"


def test_index_search_and_evaluate(spark, tmp_path):
    root, s = tmp_path / "r", store.Store(spark, str(tmp_path / "s"))
    write(root, {"src/cli.py": PY.replace("def f", "def run_server"), "README.md": "# Title\nThe server starts here."})
    first = plans.index(spark, str(root), s)
    assert (first["added"], first["modified"], first["deleted"]) == (2, 0, 0) and first["chunks"] == 5
    assert "chunks" not in plans.index(spark, str(root), s)
    write(root, {"src/cli.py": PY, "new.py": "import sys\n\ndef run_server():\n    return 1\n"})
    os.remove(root / "README.md")
    again = plans.index(spark, str(root), s)
    assert (again["added"], again["modified"], again["deleted"]) == (1, 1, 1)
    chunks = s.read(first["collection"]).cache()
    q = spark.createDataFrame([("q", "Where is run_server?")], "query_id string, question string")
    for mode in ("vector", "lexical", "hybrid"):
        assert plans.search(chunks, q, mode, 3).orderBy("rank").first()["file_path"] == "new.py"
    (tmp_path / "g.yaml").write_text("- id: a\n  question: Where is run_server?\n  expected_files: [new.py]\n- question: nothing\n")
    g = golden.load(spark, str(tmp_path / "g.yaml"))
    assert {r["mode"]: r["recall_at_1"] for r in plans.evaluate(chunks, g, ["lexical", "hybrid"]).collect()} == {"lexical": 1.0, "hybrid": 1.0}
    assert plans.manifests(spark, s).count() == 1
    with pytest.raises(ValueError):
        plans.search(chunks, q, "other")


def test_git_source(tmp_path):
    repo = tmp_path / "remote"
    run = lambda *a: subprocess.run(["git", "-c", "user.email=a@b.c", "-c", "user.name=n", *a], cwd=repo, check=True, capture_output=True)
    write(repo, {"README.md": "a"})
    run("init", "-q", "-b", "main")
    run("add", "-A")
    run("commit", "-qm", "a")
    run("checkout", "-qb", "feature")
    write(repo, {"feature.txt": "f"})
    run("add", "-A")
    run("commit", "-qm", "f")
    run("checkout", "-q", "main")
    url = f"file://{repo}"
    folder, commit = repository.checkout(url, str(tmp_path / "cache"), "feature", allow_file=True)
    assert os.path.exists(os.path.join(folder, "feature.txt")) and len(commit) == 40
    with pytest.raises(ValueError):
        repository.checkout(url, str(tmp_path / "cache"))


CHUNK_ROWS = [
    ("a", "src/cli.py", "main", None, "python", "cli cli CLI entry-point aaaa 入口 入口在"),
    ("b", "src/Other.md", None, "Cli", None, "no keyword here"),
    ("c", None, None, None, None, None),
    ("d", "x/入口.py", "aa", "aa", "python", "aaaaa aa cli.py"),
]


def test_lexical_pass_equals_joins_and_brute_force(spark):
    chunks = spark.createDataFrame(CHUNK_ROWS, "chunk_id string, file_path string, name string, parent string, language string, source string")
    questions = spark.createDataFrame([(1, "where is the cli.py 入口 aa"), (2, "Python entry-point"), (3, "the"), (4, None)], "query_id long, question string")
    words = {}
    for r in lexical.query_keywords(questions).collect():
        words.setdefault(r["query_id"], []).append(r["kw"])
    want = {}
    for q, kws in words.items():
        for ident, *fields in CHUNK_ROWS:
            path, name, parent, language, source = [(x or "").lower() for x in fields]
            score = sum(5 * (w in path) + 4 * (w in name) + 2 * (w in parent) + 0.5 * (w in language) + 0.5 * min(source.count(w), 5) for w in kws)
            if score:
                want[q, ident] = score
    as_dict = lambda df: {(r["query_id"], r["chunk_id"]): r["score"] for r in df.collect()}
    assert as_dict(lexical.lexical_scores(chunks, questions)) == want == as_dict(lexical._by_joins(chunks, questions))
    best = {q: sorted((-s, i) for (x, i), s in want.items() if x == q)[:2] for q in words}
    got = {q: [] for q in words}
    for r in lexical.lexical_topk(chunks, questions, 2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["chunk_id"]))
    assert got == best
    assert lexical.lexical_topk(chunks, questions.where("query_id = 4")).count() == 0 == lexical.lexical_scores(chunks.limit(0), questions).count()


def test_vector_topk_equals_brute_force_with_ties_and_faults(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0]), (1002, [1.0, None, 0.0, 0.0]), (1003, [0.0] * 4)]
    queries = [(i, v) for i, v in rows[:20]] + [(500, None)]
    schema = "{} long, embedding array<double>"
    got = vectors.vector_topk(spark.createDataFrame(rows + odd, schema.format("chunk_id")).repartition(5), spark.createDataFrame(queries, schema.format("query_id")), 7).collect()
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    for q, v in queries[:20]:
        want = sorted((round(1 - float(unit(v) @ unit(x)), 6), i) for i, x in [*rows, odd[-1]])[:7]
        mine = sorted((r["rank"], r["chunk_id"], r["distance"]) for r in got if r["query_id"] == q)
        assert [(i, d) for _, i, d in mine] == [(i, pytest.approx(d, abs=2e-6)) for d, i in want]
    assert len(got) == 140
    assert vectors.vector_topk(spark.createDataFrame(rows, schema.format("chunk_id")), spark.createDataFrame(queries[-1:], schema.format("query_id"))).count() == 0


def test_unit_is_computed_once(spark):
    plan = spark.range(1).select(embed.embed(F.col("id").cast("string"), "letters").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("aggregate(") <= 1  # not once an element


def test_passages_equal_brute_force(spark):
    items = [(1, "a long passage of more than twenty-four letters"), (2, "short"), (3, ""), (4, None), (5, "a long passage of more than other letters"), (6, "short")]
    texts = [(1, "x a long passage of more than twenty-four letters y a long passage of more than other"), (2, "shortshort"), (3, None), (4, ""), (2, "more short")]
    own, docs = spark.createDataFrame(items, "item_id long, item string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((i, d) for i, x in items for d, t in texts if x and t and x in t)
    assert sorted(tuple(r) for r in passages.passages(own, docs).collect()) == want
    assert {tuple(r) for r in passages._by_join(own.where("item <> ''"), docs).collect()} == set(want)


def test_context_keeps_hits_with_null_fields(spark):
    rows = [("q", 1, "doc", "n", "p", 1, 2, None, 0.5, "text"), ("q", 2, "doc", None, "p", None, 2, "md", None, None)]
    hits = spark.createDataFrame(rows, "query_id string, rank int, chunk_type string, name string, file_path string, start_line int, end_line int, language string, score double, source string")
    assert context.contexts(hits).first()["context"].count("### [doc]") == 2


def test_reports_and_comparison_of_embeddings(spark, tmp_path):
    write(tmp_path / "repo", {"src/cli.py": "import os\nX = 1\nY = 2\n\n\ndef main_entry():\n    return 1\n", "docs/a.md": "# Title\n\ntext of the guide\n"})
    st = store.Store(spark, f"file://{tmp_path}/store")
    root, key = str(tmp_path / "repo"), plans.local_key(str(tmp_path / "repo"))
    name = plans.collection_name(embed.profile_key(key, "hashing-tf"))
    assert plans.index(spark, root, st)["collection"] == name and plans.resolve(root) == ("local", root, key)
    rows = [("q1", "main_entry", ["src/cli.py"], ["main_entry"]), ("q2", "guide text", ["nowhere.py"], []), ("q3", "guide", [], [])]
    g = spark.createDataFrame(rows, "query_id string, question string, expected_files array<string>, expected_symbols array<string>")
    chunks = st.read(name)
    summary, metrics = plans.evaluate_one(chunks, g, " Lexical ")
    got = reports.evaluation(summary, metrics, "set", root, 8, "lexical")
    assert got["summary"]["total"] == 3 and got["summary"]["recall_at_1"] == 0.5 and got["summary"]["avg_latency_ms"] > 0 and len(got["per_query"]) == 3
    assert [r["query_id"] for r in evaluation.failed_samples(metrics).collect()] == ["q2"]
    path = reports.write(got, str(tmp_path / "out" / "r.json"), " JSON ")
    assert json.load(open(path, encoding="utf-8")) == got and "| Recall@1 | 50.00% |" in open(reports.write(got, str(tmp_path / "r.md"), "markdown"), encoding="utf-8").read()
    with pytest.raises(ValueError):
        reports.write(got, str(tmp_path / "r.txt"), "text")
    both = reports.comparison(plans.compare_embeddings(st, key, g, ["hashing-tf", "letters", "hashing-tf"], "hybrid"), "profile", "set")
    assert both["profiles"]["hashing-tf"]["index_exists"] and both["profiles"]["hashing-tf"]["recall_at_1"] == 0.5
    assert not both["profiles"]["letters"]["index_exists"] and "letters: no index" in reports.markdown(both) and both["profiles"]["letters"]["mrr"] is None
    modes = reports.comparison(plans.evaluate(chunks, g, plans.parse_modes("lexical, Hybrid,lexical,")), "mode")
    assert set(modes["modes"]) == {"lexical", "hybrid"} and "| hybrid |" in reports.markdown(modes)
    with pytest.raises(ValueError):
        plans.parse_modes("lexical,fuzzy")
    told = plans.run_agent(chunks, "修改 main_entry。performance of main_entry?")
    assert told["key_files"][0] == "src/cli.py" and len(told["plan"]) == 3 and not told["insufficient_evidence"] and len(told["suggested_tests"]) == 2 and agent.RISK_CHANGE in told["risks"]
    assert told["references"][0].startswith("src/cli.py:") and "# Agent report" in reports.markdown(told) and json.loads(json.dumps(told)) == told
    wanted = spark.createDataFrame([(name,), ("other",)], "collection string")
    assert {r["collection"]: (r["status"], r["files"]) for r in plans.status(spark, st, wanted).collect()} == {name: ("indexed", 2), "other": ("missing", 0)}
    assert plans.remove_manifest(st, name) and plans.manifests(spark, st).count() == 0 and st.read(name) is not None


def test_agent_brief_without_evidence(spark):
    steps = agent.plan(spark.createDataFrame([("t", "重构")], "task_id string, task string"))
    none = spark.createDataFrame([], "task_id string, pos int, rank int, file_path string")
    r = agent.briefs(steps, none).first()
    assert r["insufficient_evidence"] and r["key_files"] == [] and r["risks"] == [agent.RISK_NONE, agent.RISK_CHANGE] and r["review_note"] == agent.NOTE_NONE and r["suggested_tests"] == [agent.TEST]


def test_clones(spark, tmp_path):
    c = clones.Clones(str(tmp_path / "clones"))
    one, two = "https://a.b/c/one", "https://a.b/c/two"
    assert c.get(one) is None and c.list(spark).count() == 0 and c.prune() == []
    for u in (one, two):
        os.makedirs(c.path(u))
    first = c.update(one, None, "abc", first=True, note=1)
    again = c.update(one, "main", "def", more=2)
    assert again["cloned_at"] == first["cloned_at"] and again["metadata"] == {"note": 1, "more": 2} and c.get(one)["commit"] == "def"
    with open(f"{c.path(two)}.json", "w") as f:
        f.write("{broken")
    assert c.get(two) is None and [r["canonical_url"] for r in c.list(spark).collect()] == [one]
    assert c.remove(two) and not c.remove(two) and c.prune() == [os.path.basename(c.path(one))] and c.get(one) is None


def test_profiles_and_display(spark):
    assert embed.profile(" Hash ").dimension == 1024 and embed.profile("custom", dimension=8, profile_id="mine", query_prefix="q: ").query_prefix == "q: " and embed.listed(spark).where("profile_id = 'mine'").count() == 1
    del embed.PROFILES["mine"]
    for bad in ("nothing", "custom"):
        with pytest.raises(ValueError):
            embed.profile(bad)
    vector = lambda text, query: spark.range(1).select(embed.embed(F.lit(text), "hashing-tf-e5", query).alias("v")).first()["v"]
    assert vector("a b", True) != vector("a b", False) == vector("a b", False)
    assert one(spark, T.shortened, "x" * 61) == "..." + "x" * 57 and one(spark, T.shortened, "x" * 60) == "x" * 60
    assert one(spark, T.json_map, '{"a": "b"}') == {"a": "b"} and one(spark, T.json_map, "no") == {} and one(spark, T.json_map, None) == {}


def test_a_corrupt_pointer_is_no_snapshot(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}")
    os.makedirs(tmp_path / "c" / "pointer")
    (tmp_path / "c" / "pointer" / "part-0.json").write_text("{broken\n")
    (tmp_path / "c" / "pointer" / "000000000002.json").write_text("")  # of a writer that is lost
    assert st.read("c", "tracker", plans.TRACKER).count() == 0
    st.write("c", spark.createDataFrame([("p", "h")], plans.TRACKER), "tracker")
    assert st.read("c", "tracker", plans.TRACKER).count() == 1


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", buckets=4)
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, file_path string, ordinal long")
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "file_path string")
    s.write("c", rows(*[(f"{i}:0", f"f{i}", 0) for i in range(40)]))
    before = s._entry("c", "chunks")["parts"]
    s.replace_files("c", files("f1", "f2"), rows(("1:1", "f1", 1), ("1:1", "f1", 2)))
    after = s._entry("c", "chunks")["parts"]
    touched = {k for k in after if after[k] != before[k]}
    assert 1 <= len(touched) <= 2 and s.read("c").count() == 39
    assert [r["ordinal"] for r in s.read("c").where("file_path = 'f1'").collect()] == [1] and not s.read("c").where("file_path = 'f2'").count()
    assert s.vacuum("c") == len(touched) and s.vacuum("c") == 0 and s.read("c").count() == 39
    s.replace_files("c", files(*[f"f{i}" for i in range(40)]), rows())
    assert s.read("c").count() == 0 and s.read("c").columns == ["chunk_id", "file_path", "ordinal"]
    first, second = s.change("c"), s.change("c")
    first.write(rows(("a", "a", 1)))
    second.write(rows(("b", "b", 1)))
    second.commit()
    with pytest.raises(store.ConcurrentWrite):
        first.commit()
    assert [r["chunk_id"] for r in s.read("c").collect()] == ["b"]


def test_scan_counts_what_it_skips(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1", "b.bin": "x", "c.png": "x", ".env": "x", "d.md": "API_KEY=1", "e.py": "", "f.py": "y" * 50, "g.py": "z", ".gitignore": "g.py\n"})
    os.symlink(tmp_path / "a.py", tmp_path / "l.py")
    (tmp_path / "h.py").write_bytes(b"caf\xe9")
    skipped = scan.Counter()
    found = [x[1] for x in scan.listing(str(tmp_path), 20, skipped)]
    assert found == ["a.py", "d.md", "h.py"] and skipped == {"language": 2, "extension": 1, "name": 1, "empty": 1, "size": 1, "ignored": 1, "symlink": 1}
    got = scan.scan(spark, str(tmp_path), 20).collect()
    assert [r["rel_path"] for r in got] == ["a.py", "h.py"] and got[1]["content"] == "caf\ufffd"


@pytest.fixture
def served():
    """(address, requests) of a server that answers with the question, in two pieces where it streams."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            told = body["messages"][-1]["content"]
            fault = told == "fail"
            self.send_response(500 if fault else 200)
            self.end_headers()
            if body["stream"]:
                pieces = [{"delta": {"content": told[:2]}}, {"delta": {}}, {"delta": {"content": told[2:]}}, {"delta": {}, "finish_reason": "stop"}]
                out = "".join(f"data: {json.dumps({'choices': [p]})}\n\n" for p in pieces) + ": note\n\ndata: {}\n\ndata: [DONE]\n\n"
            else:
                out = json.dumps({"choices": [] if told == "none" else [{"message": {"content": told}}]})
            self.wfile.write(out.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", asked
    server.shutdown()
    server.server_close()


def test_model(served):
    url, asked = served
    for bad in ("", " ", None, model.PLACEHOLDER):
        with pytest.raises(ValueError):
            model.HttpModel(bad, url, "m")
    m = model.HttpModel("k", url, "m")
    assert m.generate("some {question} {context}", "where?") == "where?" and m.healthy()
    path, key, body = asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["model"] == "m" and "some {question} {context}" in body["messages"][0]["content"]
    got = list(m.stream("c", "where?"))
    assert "".join(p.content for p in got) == "where?" and [p.index for p in got] == [0, 1, 2] and got[-1].finish_reason == "stop"
    for q in ("fail", "none"):
        with pytest.raises(RuntimeError):
            m.generate("c", q)
    with pytest.raises(RuntimeError):
        list(m.stream("c", "fail"))
    assert not model.HttpModel("k", "http://127.0.0.1:9", "m", timeout=2).healthy()


def test_ask_and_chat(spark, served, tmp_path, monkeypatch, capsys):
    root = tmp_path / "r"
    write(root, {"a.py": PY, "README.md": "# Title\nThe server starts here."})
    store_at = f"file://{tmp_path}/s"
    monkeypatch.setattr(cli, "session", lambda master: spark)
    assert cli.main(["--store", store_at, "index", str(root)]) == 0
    capsys.readouterr()
    assert cli.main(["--store", store_at, "ask", str(root), "where does the server start", "--context"]) == 0
    assert "README.md" in capsys.readouterr().out
    monkeypatch.setenv("SKEIN_MODEL_URL", served[0])
    monkeypatch.setenv("SKEIN_MODEL_KEY", "k")
    monkeypatch.setattr("sys.stdin", io.StringIO("server?\n\nexit\nnever\n"))
    assert cli.main(["--store", store_at, "chat", str(root), "--mode", "lexical"]) == 0
    assert capsys.readouterr().out == "server?\n" and len(served[1]) == 1
    assert "README.md" in served[1][0][2]["messages"][0]["content"]
    chunks = store.Store(spark, store_at).read(plans.collection_name(embed.profile_key(plans.local_key(str(root)), "hashing-tf")))
    got = plans.answer(chunks, "server", model.from_environment(), mode="lexical")
    assert got["answer"] == "server" and got["hits"][0]["file_path"] == "README.md" and got["reason"] == "documents_only"


def test_embedding_by_a_model(spark):
    def missing():
        raise OSError("no such folder")

    def loader():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    embed.register(embed.Profile("lengths", 2, "q"), missing, loader)
    embed.register(embed.Profile("nowhere", 2), missing)
    try:
        vector = lambda p, query=False: spark.createDataFrame([("abc",)], "t string").select(embed.embed(F.col("t"), p, query).alias("v")).first()["v"]
        assert vector("lengths") == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and vector("lengths", True) == pytest.approx([4 / 17**0.5, 1 / 17**0.5])
        with pytest.raises(Exception, match="no such folder"):
            vector("nowhere")
    finally:
        for p in ("lengths", "nowhere"):
            del embed.PROFILES[p], embed.LOADERS[p]
    with pytest.raises(ValueError):
        embed.register(embed.Profile("x", 2))
