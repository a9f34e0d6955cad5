"""The pipeline's stages against brute-force versions of what each keeps."""

from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import decontaminate
from tests.llm.test_corpus import brute_classes
from tests.llm.test_digests import EDGE, SCHEMA, SF, brute_spans


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, SF).cache()
    assert good.columns == names and 0 < good.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r["doc_id"] for r in docs.collect() if labels.get(r["doc_id"]) == 1 and len(r["text"].split()) >= 50]
    assert sum(d in texts for d in clean) >= 0.97 * len(clean)
    single = stage["n-gram Jaccard join"](spark, good, SF).cache()
    want = {d for d, (_, c) in brute_classes(texts, 5, 80).items() if c == d}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == names and single.count() == len(want)
    free = stage["benchmark decontamination"](spark, single, SF).cache()
    leaked = {r["doc_id"] for r in decontaminate.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in free.collect()} == want - leaked
    safe = stage["personal data"](spark, free, SF).cache()
    assert {r["doc_id"] for r in safe.collect()} == want - leaked
    assert all(not brute_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in safe.collect())
    packed = stage["best-fit packing"](spark, safe, SF)
    assert {r["doc_id"] for r in packed.collect()} == want - leaked


def test_edges(spark):
    stage = dict(corpus_pipeline.STAGES)
    for docs in (spark.createDataFrame(EDGE, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name in ("quality rules", "benchmark decontamination", "personal data"):
            out = stage[name](spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
    rows = spark.createDataFrame([*EDGE, *EDGE], SCHEMA)
    kept = stage["n-gram Jaccard join"](spark, rows, SF)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 5, 6] and kept.where("doc_id IS NULL").count() == 2


def test_late_stages_on_edges(spark):
    stage = dict(corpus_pipeline.STAGES)
    empty = spark.createDataFrame([], SCHEMA)
    none = stage["n-gram Jaccard join"](spark, empty, SF)
    assert none.columns == empty.columns and none.count() == 0
    assert stage["best-fit packing"](spark, empty, SF).count() == 0
    rows = spark.createDataFrame(EDGE, SCHEMA).withColumn("sequence_id", F.lit("x")).withColumn("offset", F.lit(None).cast("string"))
    packed = stage["best-fit packing"](spark, rows, SF).collect()
    ids = [r["doc_id"] for r in rows.collect()]
    assert {r["doc_id"] for r in packed} == set(ids) and sum(r["start"] == 0 for r in packed) == len(ids)
    assert all(1 <= r["length"] <= 2048 and r["offset"] + r["length"] <= 2048 for r in packed)


def test_decontamination_goes_by_windows_of_the_items_size(spark, tmp_path, monkeypatch):
    """By long windows alone the stage drops whole copies, and changed ones of which no fingerprint is equal to one of the item's."""

    class WholeWindows(decontaminate.Index):
        """Only the windows of the items' size, as the method has them, without the short ones beside them."""

        def __init__(self, *known):
            super().__init__(*known)
            self.classes = {size: found for size, found in self.classes.items() if size > decontaminate.WIDTH}
            self.short = {}

    items = [(k, " ".join(f"i{k}x{x}" for x in range(200))) for k in range(8)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    changed = lambda t, at: " ".join([*t.split()[:at], "other", *t.split()[at + 1 :]])
    rows = [(k, "p " * (k % 5) + t) for k, t in items] + [(100 + k, changed(t, 100)) for k, t in items] + [(200, "nothing of any item " * 60)]
    monkeypatch.setattr(decontaminate, "Index", WholeWindows)
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    kept = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()}
    assert 200 in kept and not kept & set(range(8))
    index = WholeWindows(items)
    prints = {int(f) for known in index.classes.values() for f in known[0]}
    sums = [decontaminate.running(decontaminate.hashes(changed(t, 100).split())) for _, t in items]
    own = lambda s: {int(f) for size in index.classes for f in decontaminate.fingerprints(s, slice(0, len(s) - size), size)}
    apart = {100 + k for k, s in enumerate(sums) if not own(s) & prints}
    assert apart - kept
