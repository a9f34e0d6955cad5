"""Lexical channel: weighted keyword scores of all questions in one pass over the chunks.

The distinct keywords of a batch of questions are few: they are collected up to a checked bound and sent to every task as
one automaton, which finds them in a text in time linear in it. Scores of all questions are one matrix product a batch,
and a task keeps the k best of each question before anything is shuffled. Beyond the bound keywords meet texts by
equi-joins: a keyword of letters, digits, _ and - occurs only inside maximal runs of these characters, so its occurrences
are the sum over the text's runs; runs are counted per chunk, keywords meet the distinct runs on three characters, and
counts flow back. Keywords with a dot or of Han characters have run classes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from skein.functions.text import keywords_lexical, occurrences
from skein.operators.topk import TopK, slices

try:
    import ahocorasick
except ImportError:  # without it all keywords go by joins
    ahocorasick = None

#: Run classes and the keywords that live in them.
CLASSES = ((r"[a-z0-9_-]+", r"^[a-z0-9_-]+$"), (r"[a-z0-9_.-]+", r"\."), ("[一-鿿]+", "[一-鿿]"))
#: (question, keyword) rows up to which an automaton of the keywords goes to every task (some 100 bytes each), and the
#: questions of one matrix product.
PASS_ROWS, PASS_QUERIES = 200_000, 512
#: Cells of the matrix of chunks x keywords, or questions, that a task holds (doubles): a batch is scored in as many slices as that takes.
CELLS = 500_000
#: Points of a keyword in the short strings of a chunk, and of each occurrence in its source, of which so many count.
POINTS, OCCURRENCE, MOST = {"file_path": 5.0, "name": 4.0, "parent": 2.0, "language": 0.5}, 0.5, 5


def query_keywords(queries: DataFrame) -> DataFrame:
    """query_id, kw from query_id, question."""
    return queries.select("query_id", F.explode(keywords_lexical(F.col("question"))).alias("kw"))


def source_counts(chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """chunk_id, kw, n: occurrences of each distinct keyword in each chunk's source, where there are any."""
    text = chunks.select("chunk_id", F.lower("source").alias("t"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2)))
    out = None
    for run, own in CLASSES:
        kws = keywords.select("kw").distinct().where(F.col("kw").rlike(own)).select("kw", F.substring("kw", 1, 3).alias("g"))
        runs = text.select("chunk_id", F.explode(F.regexp_extract_all("t", F.lit(run), F.lit(0))).alias("run")).groupBy("chunk_id", "run").agg(F.count("*").alias("m"))
        three = F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - 2, F.lit(1))), lambda i: F.col("run").substr(i, F.lit(3)))
        vocabulary = runs.select("run").distinct()
        pieces = vocabulary.select("run", F.explode(F.array_distinct(F.concat(three, grams(F.col("run"))))).alias("g"))
        met = pieces.join(kws, "g").where(F.col("run").contains(F.col("kw"))).select("run", "kw", occurrences(F.col("run"), F.col("kw")).alias("k"))
        part = runs.join(met, "run").select("chunk_id", "kw", (F.col("m") * F.col("k")).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("chunk_id", "kw").agg(F.sum("n").alias("n"))


def _short_terms(chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """chunk_id, kw, points of path, name, parent and language, over the distinct short strings."""
    strings = chunks.select("file_path", "name", "parent", "language").distinct()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    has = lambda c, points: F.when(low(c).contains(F.col("kw")), points).otherwise(0.0)
    score = sum(has(c, points) for c, points in POINTS.items())
    # keywords meet the strings that hold their first two or three characters, by an equi-join
    text = F.concat_ws("\n", *[low(c) for c in POINTS])
    places = F.sequence(F.lit(1), F.greatest(F.char_length("t"), F.lit(1)))
    cut = lambda n: F.transform(places, lambda i: F.col("t").substr(i, F.lit(n)))
    pieces = F.array_distinct(F.concat(cut(2), cut(3)))
    kws = keywords.select("kw").distinct().withColumn("g", F.substring("kw", 1, 3))
    met = strings.withColumn("t", text).withColumn("g", F.explode(pieces)).join(kws, "g").withColumn("points", score).where("points > 0").drop("t", "g")
    same = [chunks[c].eqNullSafe(met[c]) for c in ("file_path", "name", "parent", "language")]
    return chunks.join(met, same[0] & same[1] & same[2] & same[3]).select(chunks["chunk_id"], "kw", "points")


def _by_joins(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    words = query_keywords(queries)
    counted = source_counts(chunks, words).select("chunk_id", "kw", (F.least("n", F.lit(MOST)) * OCCURRENCE).alias("points"))
    points = counted.unionByName(_short_terms(chunks, words)).groupBy("chunk_id", "kw").agg(F.sum("points").alias("points"))
    return points.join(words, "kw").groupBy("query_id", "chunk_id").agg(F.sum("points").alias("score")).where("score > 0")


class Questions:
    """The keywords of a batch of questions: which question (by place in ids) has which keyword (by place in words)."""

    def __init__(self, rows: list):
        self.ids = sorted({r["query_id"] for r in rows})
        self.words = sorted({r["kw"] for r in rows})
        number, place = {q: i for i, q in enumerate(self.ids)}, {w: i for i, w in enumerate(self.words)}
        self.of = np.array([(number[r["query_id"]], place[r["kw"]]) for r in rows], np.int64).reshape(-1, 2)

    def automaton(self):
        out = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            out.add_word(w, (i, len(w)))
        out.make_automaton()
        return out

    def points(self, batch: pa.RecordBatch, automaton) -> np.ndarray:
        """Chunks x keywords."""
        out = np.zeros((batch.num_rows, len(self.words)))
        for name, points in POINTS.items():
            known: dict[str, list[int]] = {}
            for row, s in enumerate(batch.column(name).to_pylist()):
                if s not in known:
                    known[s] = sorted({i for _, (i, _) in automaton.iter(s)})
                out[row, known[s]] += points
        for row, s in enumerate(batch.column("source").to_pylist()):
            ends: dict[int, int] = {}
            seen: dict[int, int] = {}
            for end, (i, n) in automaton.iter(s):
                if end - n >= ends.get(i, -1):  # occurrences do not overlap
                    ends[i] = end
                    seen[i] = seen.get(i, 0) + 1
            for i, n in seen.items():
                out[row, i] += min(n, MOST) * OCCURRENCE
        return out


def _in_one_pass(chunks: DataFrame, queries: DataFrame, rows: list, k: int | None) -> DataFrame:
    """query_id, chunk_id, score: of every task the k best of each question, or all with a positive score."""
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c)
    sent = chunks.sparkSession.sparkContext.broadcast(Questions(rows))
    query_type, chunk_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (chunks, "chunk_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        automaton = asked.automaton()
        ids = np.array(asked.ids, object)
        parts = []
        for at in range(0, len(ids), PASS_QUERIES):
            own = asked.of[(asked.of[:, 0] >= at) & (asked.of[:, 0] < at + PASS_QUERIES)]
            use, place = np.unique(own[:, 1], return_inverse=True)
            weights = np.zeros((len(ids[at : at + PASS_QUERIES]), len(use)))
            weights[own[:, 0] - at, place] = 1
            parts.append((at, use, weights, TopK(len(weights), k) if k else None))

        def told(query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[query].tolist(), query_type), pa.array(chunk, chunk_type), pa.array(score)], ["query_id", "chunk_id", "score"])

        for batch in slices(batches, max(len(asked.words), min(PASS_QUERIES, len(ids))), CELLS):
            points = asked.points(batch, automaton)
            chunk = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for at, use, weights, best in parts:
                scores = weights @ points[:, use].T
                if best:
                    best.add(np.where(scores > 0, -scores, np.inf), chunk)
                else:
                    query, row = np.nonzero(scores > 0)
                    yield told(query + at, chunk[row], scores[query, row])
        for at, _, _, best in parts if k else ():
            if best.found is not None:
                query, value, ident = best.found
                yield told(query + at, ident, -value)

    return chunks.select("chunk_id", *[low(c) for c in (*POINTS, "source")]).mapInArrow(run, kinds)


def _scored(chunks: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    rows = query_keywords(queries).limit(PASS_ROWS + 1).collect() if ahocorasick else None
    if rows is None or len(rows) > PASS_ROWS:
        return _by_joins(chunks, queries)
    if not rows:
        return queries.join(chunks.select("chunk_id"), F.lit(False)).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
    return _in_one_pass(chunks, queries, rows, k)


def lexical_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of every pair with a positive score.

    chunks: chunk_id, file_path, name, parent, language, source. queries: query_id (text or integer), question.
    """
    return _scored(chunks, queries, None)


def ranked(hits: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The k first of each query with rank; Spark keeps k rows per partition before it shuffles."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    return ranked(_scored(chunks, queries, k), k, [F.col("score").desc(), F.col("chunk_id")])
