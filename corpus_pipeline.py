"""From raw documents to packed training sequences: five stages, each by one operator of skein.llm.

Every stage gets the documents that the one before has kept and written. Null ids, null or empty texts and repeated
rows are treated as the operators define; a stage on an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from skein.llm.common import staged

#: Near-duplicate stage: words of a shingle, least similarity in per cent.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that the rules remove; n_chars follows the text.

    The row number keeps the filter above the projections: pushed below, it would repeat their nested expressions.
    """
    found = quality_rules.quality(docs).withColumn("_n", F.monotonically_increasing_id()).where("kept AND _n >= 0")
    renewed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return found.select(*[renewed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of linked texts: that of the smallest id. Each row is judged by its own text, whatever else
    stands under its id; rows with an empty text stay, equal rows of one id give one, rows without an id stay."""
    keyed = docs.where("doc_id IS NOT NULL").withColumn("_key", F.xxhash64("doc_id", "text"))
    classes = jaccard_join.classes(keyed.select(F.col("_key").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY_PERCENT)
    found = classes.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_class")).distinct()
    first = F.min_by("_key", F.struct("doc_id", "_key")).alias("_key")
    keep = staged(keyed.select("_key", "doc_id").distinct().join(found, "_key").groupBy("_class").agg(first).select("_key"), "kept")
    return keyed.join(keep, "_key").dropDuplicates(["_key"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]
#: Fingerprints, classes and packing have no SQL form: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
