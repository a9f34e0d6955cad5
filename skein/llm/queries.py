"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bilinear_lm, conversation_repair, decontaminate, hard_negatives, jaccard_join, license_scan, packing, pii, quality_rules, spot_signatures, style_tree, token_orc, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_weak_supervision_pii": lambda spark, d: pii.digest(_docs(spark, d)),
    "op2_site_style_tree": lambda spark, d: style_tree.extract(spark.read.parquet(f"{d}/pages.parquet")),
    "op3_license_scan": lambda spark, d: license_scan.licenses(_docs(spark, d)),
    "op4_genetic_packing": lambda spark, d: packing.packed(_docs(spark, d), VOCABULARY),
    "op5_ngram_jaccard_join": lambda spark, d: jaccard_join.classes(_docs(spark, d)),
    "op6_quality_rules": lambda spark, d: quality_rules.digest(_docs(spark, d)),
    "op7_token_orc": lambda spark, d: token_orc.digest(_docs(spark, d), VOCABULARY),
    "op8_benchmark_decontamination": lambda spark, d: decontaminate.digest(_docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op9_log_bilinear_lm": lambda spark, d: bilinear_lm.scores(_docs(spark, d)),
    "op10_noisy_channel_toxicity": lambda spark, d: toxicity.digest(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op11_distance_key_negatives": lambda spark, d: hard_negatives.mined(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op12_spot_signatures": lambda spark, d: spot_signatures.digest(_docs(spark, d)),
    "op13_conversation_repair": lambda spark, d: conversation_repair.digest(spark.read.parquet(f"{d}/conversations.parquet")),
    "pipeline": corpus_pipeline.run,
}
#: What of operators 1, 3 and 9 SQL can say: the columns that the contract fixes; and the near-duplicates of operator 12.
QUERIES |= {
    "spot_signature_classes": lambda spark, d: spot_signatures.classes(_docs(spark, d)),
    "base_personal_data": lambda spark, d: pii.digest(_docs(spark, d)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "base_license_phrases": lambda spark, d: license_scan.licenses(_docs(spark, d)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "base_language_model": lambda spark, d: bilinear_lm.scores(_docs(spark, d)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score")),
}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIGITS = "list_transform(string_split(regexp_replace(x, '[^0-9]', '', 'g'), ''), lambda c: CAST(c AS INT))"
_PHRASES = "[" + ", ".join(f"{{'w': {p.split()}, 'label': '{label}'}}" for p, label in license_scan.BASE) + "]"
#: CRC-32 of doc_id as text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda x: CAST(0 AS BIGINT))), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""
ORACLES = {
    "op5_ngram_jaccard_join": jaccard_join.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op11_distance_key_negatives": hard_negatives.ORACLE,
    "op12_spot_signatures": spot_signatures.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
    "spot_signature_classes": spot_signatures.CLASSES_ORACLE,
    "base_personal_data": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS e,
  regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: {_DIGITS}) AS c,
  list_transform(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS p FROM d)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: len(x) BETWEEN 16 AND 19 AND list_sum(list_transform(list_reverse(x), lambda y, k: CASE WHEN k % 2 = 1 THEN y WHEN y > 4 THEN 2 * y - 9 ELSE 2 * y END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: x BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM f""",
    "base_license_phrases": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT rid, p.label AS label, i - 1 AS b FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT unnest({_PHRASES}) AS p) WHERE w[i] = p.w[1] AND w[i:i + len(p.w) - 1] = p.w),
g AS (SELECT rid, count(*) AS n, min(b) AS a, max(b) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM f GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (rid)""",
    "base_language_model": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_append(list_filter(string_split_regex({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), NULL) AS w FROM documents),
t AS (SELECT rid, doc_id, unnest(w) AS w FROM d),
o AS (SELECT DISTINCT doc_id, {_CRC32} % 5 = 1 AS held_out FROM d),
c AS (SELECT coalesce(w, ' ') AS w, count(*) AS c FROM t JOIN o USING (doc_id) WHERE NOT held_out GROUP BY 1),
a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT t.doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(a.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (a.n + 0.5 * (a.v + 1)))), 4) AS base_score
FROM t JOIN o ON o.doc_id = t.doc_id LEFT JOIN c ON c.w = coalesce(t.w, ' '), a GROUP BY t.rid, t.doc_id""",
}
