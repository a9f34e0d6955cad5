"""Context blocks for a language model from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import escape_context


def block(escape: bool = True) -> Column:
    """One hit in the fixed form; score with four places, N/A without one. A null field is empty: no hit is lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = escape_context(text("source")) if escape else text("source")
    score = F.coalesce(F.format_string("%.4f", F.col("score").cast("double")), F.lit("N/A"))
    span = F.concat(text("start_line"), F.lit("-"), text("end_line"))
    return F.concat(
        F.lit("### ["), text("chunk_type"), F.lit("] "), text("name"), F.lit("\n- file: "), text("file_path"), F.lit("\n- lines: "), span, F.lit("\n- language: "), text("language"),
        F.lit("\n- score: "), F.when(F.col("score").isNull(), "N/A").otherwise(score), F.lit("\n```"), text("language"), F.lit("\n"), body, F.lit("\n```"),
    )


def contexts(hits: DataFrame, max_chunks: int | None = None, escape: bool = True) -> DataFrame:
    """query_id, context: the hits' blocks in order of rank; a query's hits are few (top-k)."""
    use = hits if max_chunks is None else hits.where(F.col("rank") <= max_chunks)
    parts = use.select("query_id", F.struct("rank", block(escape).alias("b")).alias("p"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "\n---\n\n").alias("context"))


def summaries(hits: DataFrame) -> DataFrame:
    """query_id, n, files (first five in order), languages."""
    g = hits.groupBy("query_id").agg(F.count("*").cast("long").alias("n"), F.array_sort(F.collect_set("file_path")).alias("f"), F.array_sort(F.collect_set("language")).alias("l"))
    return g.select("query_id", "n", F.array_join(F.slice("f", 1, 5), ",").alias("files"), F.array_join("l", ",").alias("languages"))
