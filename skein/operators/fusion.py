"""Reciprocal-rank fusion of any number of channels by one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 60


def rrf(channels: dict[str, DataFrame], k: int = 8, weights: dict[str, float] | None = None, rrf_k: int = K) -> DataFrame:
    """query_id, chunk_id, score, stage (first channel), channels, rank. Each channel: query_id, chunk_id, rank.

    A chunk that a channel lists twice adds twice. Ties: by channel order, then the first rank there.
    """
    weights = weights or {}
    cols = ["query_id", "chunk_id", "rank"]
    parts = [df.select(*cols, F.lit(name).alias("channel"), F.lit(i).alias("o"), F.lit(float(weights.get(name, 1.0))).alias("w")) for i, (name, df) in enumerate(channels.items())]
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("w") / (rrf_k + F.col("rank"))).alias("raw"), F.min(F.struct("o", "rank", "channel")).alias("first"), F.array_sort(F.collect_set(F.struct("o", "channel"))).alias("seen")
    )
    fused = fused.select("query_id", "chunk_id", F.round("raw", 9).alias("score"), "first", F.col("first.channel").alias("stage"), F.array_join("seen.channel", ",").alias("channels"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("first.o"), F.col("first.rank"), F.col("chunk_id"))
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")
