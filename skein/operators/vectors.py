"""Vector channel: exact cosine top-k by blocks of queries, boost, threshold with fallback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from skein.operators.topk import TopK, slices

#: Queries of one matrix product, its cells (doubles; a batch is taken in as many slices as that takes), and bytes of query
#: vectors that go to every task at once.
BLOCK_QUERIES, CELLS, ROUND_BYTES = 1024, 1 << 20, 64 << 20
ROUND = 6


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays. Vector and norm are bound to lambda variables, so each is computed once."""
    normed = F.transform(F.array(v.cast("array<double>")), lambda d: F.struct(d.alias("d"), F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    return F.transform(normed, lambda s: F.when(s["n"] == 0, s["d"]).otherwise(F.transform(s["d"], lambda x: x / s["n"])))[0]


def _matrix(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of that dimension without nulls, and those rows at length 1."""
    values, ends = column.flatten(), np.asarray(column.value_lengths().fill_null(0))
    good = ends == dimension
    flat = values.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    x = flat[np.repeat(good, ends)].reshape(-1, dimension)
    whole = ~np.isnan(x).any(1)
    good[np.flatnonzero(good)[~whole]] = False
    x = x[whole]
    return good, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def distances(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance: of each task the k nearest to each query. Ties by chunk_id.

    vectors: chunk_id, embedding. queries: query_id, embedding, of one dimension. A vector that is null, holds a null or
    has another dimension is near no query, and a query without a vector has no hits. One scan serves as many queries as
    ROUND_BYTES hold, in matrix products of BLOCK_QUERIES; more queries take more scans.
    """
    spark, out = vectors.sparkSession, None
    known = queries.select("query_id", "embedding").where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    sizes = known.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dimension = sizes["d"] or 1
    rounds = max(1, -(-sizes["n"] * dimension * 8 // ROUND_BYTES))
    numbered = known if rounds == 1 else known.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(rounds)))
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, distance double"
    types = [to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (vectors, "chunk_id"))]
    for b in range(rounds):
        got = (numbered if rounds == 1 else numbered.where(F.col("_b") == b)).select("query_id", "embedding").orderBy("query_id").collect()
        got = [r for r in got if len(r["embedding"]) == dimension]
        if not got:
            continue
        q = np.array([r["embedding"] for r in got], float)
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in got], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, unit_q = sent.value
            blocks = [(at, TopK(len(unit_q[at : at + BLOCK_QUERIES]), k)) for at in range(0, len(unit_q), BLOCK_QUERIES)]
            for batch in slices(batches, min(BLOCK_QUERIES, len(unit_q)), CELLS):
                good, x = _matrix(batch.column("embedding"), unit_q.shape[1])
                own = batch.column("chunk_id").to_numpy(zero_copy_only=False)[good]
                for at, best in blocks if len(own) else ():
                    best.add(np.round(1 - unit_q[at : at + BLOCK_QUERIES] @ x.T, ROUND) + 0.0, own)  # no negative zero
            for at, best in blocks:
                if best.found is not None:
                    query, value, ident = best.found
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([ids[at + i] for i in query.tolist()], types[0]), "chunk_id": pa.array(ident, types[1]), "distance": pa.array(value)})

        one = vectors.select("chunk_id", "embedding").mapInArrow(run, kinds)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], kinds) if out is None else out


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 8, max_distance: float | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank of the k nearest, those farther than max_distance left out."""
    near = distances(vectors, queries, k)
    near = near if max_distance is None else near.where(F.col("distance") <= max_distance)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("rank") <= k)


def boost_and_cut(hits: DataFrame, boosted: Column, k: int = 8, threshold: float = 0.7) -> DataFrame:
    """Hits with a keyword in their metadata first, then those within the threshold (all, if none is), then the first k."""
    order = [boosted.desc(), F.col("rank")]
    marked = hits.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).withColumn("near", F.col("distance") <= threshold)
    kept = marked.withColumn("any_near", F.max("near").over(W.partitionBy("query_id"))).where(F.col("near") | ~F.col("any_near"))
    return kept.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).where(F.col("final_rank") <= k).drop("near", "any_near", "pos")


def candidates(k: int) -> int:
    """How many neighbours are fetched before boost and threshold."""
    return max(5 * k, 50)
