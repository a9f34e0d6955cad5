"""Steps whose memory or shuffle must not outgrow the input."""

import pyarrow as pa

from skein.operators import embed, lexical, topk
from skein.plans import reference
from skein.sources import store
from skein.sources.store import Store

SF = "/root/testdata/sf0.1"


def test_a_label_channel_joins_the_first_of_each_label_only(spark, monkeypatch):
    seen, ranked = [], reference.lexical.ranked
    monkeypatch.setattr(reference.lexical, "ranked", lambda hits, *a, **k: seen.append(hits) or ranked(hits, *a, **k))
    got = sorted(tuple(r) for r in reference._label_channel(spark, SF, 20).select("query_id", "chunk_id", "rank").collect())
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()
    first = {x: sorted(r["vec_id"] for r in v if r["label"] == x)[:20] for x in {r["label"] for r in v} - {None}}
    assert got == sorted((r["vec_id"], c, i) for r in v if r["vec_id"] % 100 == 0 for i, c in enumerate(first.get(r["label"], []), 1))
    assert max(hits.count() for hits in seen) <= len(v)  # not queries x vectors of a label


def test_slices_bound_a_matrix():
    batches = [pa.record_batch({"x": list(range(n))}) for n in (0, 7, 10_000)]
    got = list(topk.slices(iter(batches), 1024, 1 << 20))
    assert [x for b in got for x in b.column("x").to_pylist()] == [x for b in batches for x in b.column("x").to_pylist()]
    assert max(b.num_rows for b in got) * 1024 <= 1 << 20


def test_known_texts_are_not_dealt_out_again(spark, tmp_path):
    kept = embed.SharedEmbeddings(Store(spark, str(tmp_path)), 4)
    rows = lambda words: spark.createDataFrame([(w, w) for w in words], "chunk_id string, source string")
    assert kept.add(rows(["a", "b", "b", ""]), "letters") == 3
    assert kept.store.change(embed.SHARED).tables and kept.add(rows(["b", "a", ""]), "letters") == 0
    states = len(kept.store._names(f"{tmp_path}/{embed.SHARED}/new"))
    assert states == 1  # nothing was staged for the second table
    for sent in (embed.SENT, 0):  # few missing hashes go to every task, many meet the texts by a join
        embed.SENT, was = sent, embed.SENT
        try:
            assert kept.add(rows(["a", "c", "c", f"d{sent}"]), "letters") == (2 if sent else 1)
        finally:
            embed.SENT = was
    assert kept.store.read(embed.SHARED, "vectors").count() == 6


def test_rows_without_repeated_ids_are_written_without_a_window(spark, monkeypatch, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i, f"f{i[0]}", n, f"s{n}") for n, i in enumerate(ids)], "chunk_id string, file_path string, ordinal int, source string")
    called, first = [], store.keep_first
    monkeypatch.setattr(store, "keep_first", lambda *a: called.append(a) or first(*a))
    kept = Store(spark, str(tmp_path), 4)
    kept.replace_files("c", rows(["a1", "b1"]).select("file_path"), rows(["a1", "b1", "b2"]))
    assert not called and kept.read("c").count() == 3
    kept.replace_files("c", rows(["a1"]).select("file_path"), rows(["a1", "a1", "a2"]))
    assert len(called) == 1 and sorted((r["chunk_id"], r["ordinal"]) for r in kept.read("c").collect()) == [("a1", 0), ("a2", 2), ("b1", 1), ("b2", 2)]


def test_a_lexical_matrix_is_bounded_whatever_the_batch(spark):
    assert 8 * lexical.CELLS <= 4 << 20  # bytes of a task's matrix of chunks x keywords
    chunks = spark.createDataFrame([(i, f"f{i}", f"f{i}", None, "en", f"alpha beta{i % 3}") for i in range(50)], "chunk_id long, file_path string, name string, parent string, language string, source string")
    asked = spark.createDataFrame([("q", "beta1 alpha"), ("r", "beta2")], "query_id string, question string")
    whole = sorted(tuple(r) for r in lexical.lexical_scores(chunks, asked).collect())
    lexical.CELLS, was = 7, lexical.CELLS
    try:
        assert whole and sorted(tuple(r) for r in lexical.lexical_scores(chunks, asked).collect()) == whole
    finally:
        lexical.CELLS = was
