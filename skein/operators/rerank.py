"""Rerankers: functions from hits to hits, put behind a search by DataFrame.transform.

`diverse` is maximal marginal relevance: of a query's candidates the one is taken next that is near the query and far from those
taken before, by weight * similarity(query) - (1 - weight) * greatest similarity(taken). A query's candidates are bounded
(CANDIDATES, by rank, as many as a search fetches), so a query is one small group; queries are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of a query that a reranker looks at, by their rank: what a search over-fetches.
CANDIDATES = 250
ROUND = 6


def _selected(candidates: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    own = candidates.sort_values(["rank", "chunk_id"]).reset_index(drop=True)
    x = np.array(own["embedding"].tolist(), float).reshape(len(own), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    q = np.array(own["query_vector"].iloc[0], float)
    near = np.round(x @ (q / max(np.linalg.norm(q), 1e-300)), ROUND)
    alike, open_, taken = np.full(len(own), -np.inf), np.ones(len(own), bool), []
    for _ in range(min(k, len(own))):
        score = weight * near - (1 - weight) * np.where(np.isinf(alike), 0.0, alike)
        best = int(np.argmax(np.where(open_, np.round(score, ROUND), -np.inf)))  # of equal ones the first by rank
        taken.append((best, round(float(score[best]), ROUND)))
        open_[best] = False
        alike = np.maximum(alike, np.round(x @ x[best], ROUND))
    at = [b for b, _ in taken]
    return pd.DataFrame({"query_id": own["query_id"].iloc[at].to_numpy(), "chunk_id": own["chunk_id"].iloc[at].to_numpy(), "score": [s for _, s in taken], "rank": np.arange(1, len(at) + 1, dtype=np.int32)})


def diverse(vectors: DataFrame, queries: DataFrame, k: int = 8, weight: float = 0.7) -> Callable[[DataFrame], DataFrame]:
    """A reranker: hits (query_id, chunk_id, rank) to query_id, chunk_id, score, rank. vectors: chunk_id, embedding. queries:
    query_id, embedding. Hits without a vector go; a query without one keeps no hit."""
    if k < 1 or not 0 <= weight <= 1:
        raise ValueError("k is at least 1 and weight from 0 to 1")

    def apply(hits: DataFrame) -> DataFrame:
        kinds = f"query_id {dict(hits.dtypes)['query_id']}, chunk_id {dict(hits.dtypes)['chunk_id']}, score double, rank int"
        told = hits.where(F.col("rank") <= CANDIDATES).select("query_id", "chunk_id", "rank")
        told = told.join(vectors.where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")), "chunk_id")
        told = told.join(queries.where("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("query_vector")), "query_id")
        return told.groupBy("query_id").applyInPandas(lambda pdf: _selected(pdf, k, weight), kinds)

    return apply


def by_score(column: str, k: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A reranker that orders hits by a column they carry, greatest first, then by their rank."""
    from skein.operators.lexical import ranked

    def apply(hits: DataFrame) -> DataFrame:
        return ranked(hits.withColumnRenamed("rank", "_was"), k, [F.col(column).desc_nulls_last(), F.col("_was")]).drop("_was")

    return apply
