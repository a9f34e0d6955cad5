"""Relations between symbols by their line ranges: which class holds which method.

Ranges of lines are cut into bins, and a range meets another of its file by an equi-join of (file, bin), at the bin in which
the inner one begins: a class of many lines is in several bins, a method in one. So no file's classes are held against all
of its methods. The innermost class that holds a method is the one that begins last and, of those, ends first.

Ranges whose end lies before their start, or with a null bound, hold nothing and are in nothing. Equal rows count once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a bin.
BIN = 64


def containing(outer: DataFrame, inner: DataFrame, key: str = "file_path") -> DataFrame:
    """Pairs of ranges (key, start_line, end_line, name) of which the first holds the second; names with outer_ and inner_."""
    own = lambda df, p: df.where("start_line <= end_line").select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("name", "start_line", "end_line")])
    bins = F.sequence(F.floor(F.col("outer_start_line") / BIN), F.floor(F.col("outer_end_line") / BIN))
    left = own(outer, "outer").withColumn("bin", F.explode(bins))
    right = own(inner, "inner").withColumn("bin", F.floor(F.col("inner_start_line") / BIN))
    inside = (F.col("outer_start_line") <= F.col("inner_start_line")) & (F.col("inner_end_line") <= F.col("outer_end_line"))
    return left.join(right, [key, "bin"]).where(inside).drop("bin")


def members(symbols: DataFrame, key: str = "file_path") -> DataFrame:
    """key, name, start_line, end_line, class_name, class_start: every function with its innermost class, null outside of any.
    symbols: key, kind (class or function), name, start_line, end_line."""
    functions = symbols.where("kind = 'function'").select(key, "name", "start_line", "end_line")
    met = containing(symbols.where("kind = 'class'"), functions.distinct(), key)
    best = F.max_by(F.struct("outer_name", "outer_start_line"), F.struct("outer_start_line", -F.col("outer_end_line"), "outer_name")).alias("c")
    inner = met.groupBy(key, *[F.col(f"inner_{c}").alias(c) for c in ("name", "start_line", "end_line")]).agg(best)
    return functions.join(inner, [key, "name", "start_line", "end_line"], "left").select(key, "name", "start_line", "end_line", F.col("c.outer_name").alias("class_name"), F.col("c.outer_start_line").alias("class_start"))


def class_sizes(symbols: DataFrame, key: str = "file_path") -> DataFrame:
    """key, class_name, class_start, methods, lines of every class that has methods: counts over members()."""
    own = members(symbols, key).where("class_name IS NOT NULL")
    return own.groupBy(key, "class_name", "class_start").agg(F.count("*").alias("methods"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))
