"""Retrieval quality: hits per query, and averages by any grouping (mode, profile) in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import normalized

CUTS = (1, 3, 8)


def matches(value: Column, expected: Column) -> Column:
    """Some expected string stands in the value, after normalisation."""
    return F.coalesce(F.exists(expected, lambda e: normalized(value).contains(normalized(e)) & (normalized(e) != "")), F.lit(False))


def per_query(golden: DataFrame, hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """golden: query_id, expected_files, expected_symbols. hits: query_id, rank, file_path, name, parent and grouping columns.

    recall_at_k says whether the first hit of a file or symbol is within k; rr is one over its rank.
    """
    by = by or []
    groups = hits.select(*by).distinct() if by else None
    base = golden.join(F.broadcast(groups)) if by else golden  # a few modes or profiles, all of them for each query
    keys = ["query_id", *by]
    found = base.join(hits, keys, "left")
    file_hit = matches(F.col("file_path"), F.col("expected_files"))
    symbol_hit = matches(F.col("name"), F.col("expected_symbols")) | matches(F.coalesce("parent", F.lit("")), F.col("expected_symbols"))
    out = found.groupBy(*keys).agg(
        F.min(F.when(file_hit | symbol_hit, F.col("rank"))).alias("first_hit_rank"),
        F.coalesce(F.bool_or(file_hit), F.lit(False)).alias("file_hit"),
        F.coalesce(F.bool_or(symbol_hit), F.lit(False)).alias("symbol_hit"),
        F.max(F.size("expected_files") > 0).alias("has_files"),
        F.max(F.size("expected_symbols") > 0).alias("has_symbols"),
        F.count("rank").alias("n_hits"),
    )
    cut = [F.coalesce(F.col("first_hit_rank") <= k, F.lit(False)).cast("int").alias(f"recall_at_{k}") for k in CUTS]
    return out.select("*", *cut, F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)).cast("double").alias("rr"))


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Averages over queries with an expectation; file and symbol hits over those that expect one."""
    scored = F.col("has_files") | F.col("has_symbols")
    mean = lambda c, cond: F.round(F.coalesce(F.avg(F.when(cond, F.col(c).cast("double"))), F.lit(0.0)), 9)
    aggs = [F.count("*").alias("total"), F.count(F.when(scored, 1)).alias("scored")]
    aggs += [mean(f"recall_at_{k}", scored).alias(f"recall_at_{k}") for k in CUTS]
    aggs += [mean("rr", scored).alias("mrr"), mean("file_hit", F.col("has_files")).alias("file_hit_rate"), mean("symbol_hit", F.col("has_symbols")).alias("symbol_hit_rate")]
    return metrics.groupBy(*(by or [])).agg(*aggs)


def with_latency(summaries: DataFrame, metrics: DataFrame, times: DataFrame, by: list[str] | None = None) -> DataFrame:
    """summaries and avg_latency_ms, over all queries. times: query_id, elapsed_ms and the grouping columns; 0 without any."""
    by = by or []
    mean = metrics.select("query_id", *by).join(times, ["query_id", *by]).groupBy(*by).agg(F.round(F.avg("elapsed_ms"), 2).alias("avg_latency_ms"))
    joined = summaries.join(F.broadcast(mean), by, "left") if by else summaries.join(F.broadcast(mean))  # a row a group
    return joined.withColumn("avg_latency_ms", F.coalesce("avg_latency_ms", F.lit(0.0)))


def failed_samples(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The first n queries with an expectation that no hit met, neither file nor symbol."""
    return metrics.where((F.col("has_files") | F.col("has_symbols")) & ~F.col("file_hit") & ~F.col("symbol_hit")).orderBy("query_id").limit(n)


def confidence(hits: DataFrame, queries: DataFrame, mode: str = "hybrid") -> DataFrame:
    """low_confidence and reason of each query: no hit, documents only, or too far on average (vector mode)."""
    seen = queries.select("query_id").join(hits, "query_id", "left").groupBy("query_id").agg(
        F.count("rank").alias("n"), F.sum((F.col("chunk_type") != "doc").cast("int")).alias("code"), F.avg("score").alias("mean_score")
    )
    far = F.lit(mode == "vector") & (F.col("mean_score") > 1.0)
    reason = F.when(F.col("n") == 0, "no_hits").when(F.col("code") == 0, "documents_only").when(far, "too_far").otherwise("")
    return seen.select("query_id", (reason != "").alias("low_confidence"), reason.alias("reason"))
