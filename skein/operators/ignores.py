"""Ignore rules as a table: which paths the rule files of their folders leave out.

A path's folders are exploded and met with the rules of each by an equi-join, so a path is held against the rules in its
scope only, however many folders have rules. Of the rules that match the last counts: deeper folders after shallower ones,
lines in their order. A path goes, too, when a folder above it is ignored, since a scan would not enter that folder.

Patterns: * and ? within a name, ** for any number of folders, [...] sets, a leading ! takes back, a trailing / matches folders
only, and a / elsewhere ties the pattern to its folder; without one it may begin at any depth. A pattern matches what it names
and all below. Blank lines and lines that begin with # are no rules. Null paths and null patterns take no part; equal paths
are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_of(path: Column) -> Column:
    """What stands before the last slash; '' at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _pattern(p: Column) -> Column:
    """A rule's pattern, without its slashes at the ends, as a regular expression of relative paths."""
    text = F.regexp_replace(p, r"([\\.+^$(){}|])", r"\\$1")
    for old, new in (("**/", "\x01"), ("/**", "\x02"), ("**", "\x03"), ("*", "[^/]*"), ("?", "[^/]"), ("[!", "[^"), ("\x01", "(?:[^/]+/)*"), ("\x02", "(?:/.*)?"), ("\x03", ".*")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def parsed(files: DataFrame) -> DataFrame:
    """folder, line, negated, only_folders, regex of the rules in rule files (folder, content)."""
    lines = files.where("content IS NOT NULL").select("folder", F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.rtrim("text")).where("text <> '' AND NOT startswith(text, '#')")
    own = lines.withColumn("negated", F.startswith("text", F.lit("!"))).withColumn("p", F.when(F.col("negated"), F.expr("substring(text, 2)")).otherwise(F.col("text")))
    own = own.withColumn("only_folders", F.endswith("p", F.lit("/"))).withColumn("p", F.regexp_replace("p", "/+$", ""))
    tied = F.contains("p", F.lit("/"))
    own = own.select("folder", "line", "negated", "only_folders", tied.alias("tied"), F.regexp_replace("p", "^/+", "").alias("p")).where("p <> ''")
    regex = F.concat(F.when(F.col("tied"), "^").otherwise("^(?:.*/)?"), _pattern(F.col("p")), F.lit("(?:/.*)?$"))
    return own.select("folder", "line", "negated", "only_folders", regex.alias("regex"))


def _with_folders(paths: DataFrame) -> DataFrame:
    """path, is_folder of the paths and of every folder above one."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("is_folder")))
    return paths.where("path IS NOT NULL AND path <> ''").select(F.explode(above).alias("x")).select("x.*").distinct()


def _matched(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, is_folder, ignored: by the last rule in scope that matches it; not ignored without one."""
    folder = folder_of(F.col("path"))
    parts = F.split(folder, "/")
    scopes = F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    scoped = paths.select("path", "is_folder", F.explode(scopes).alias("folder"))
    met = scoped.join(rules, "folder").where(~F.col("only_folders") | F.col("is_folder"))
    own = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, char_length(folder) + 2)"))
    met = met.where(F.rlike(own, F.col("regex")))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    last = met.groupBy("path", "is_folder").agg(F.max_by(~F.col("negated"), F.struct(depth, "line")).alias("ignored"))
    return paths.join(last, ["path", "is_folder"], "left").select("path", "is_folder", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def ignored(paths: DataFrame, files: DataFrame) -> DataFrame:
    """path, ignored of each distinct path. paths: path (of files, relative, with /). files: folder ('' at the top), content."""
    every = _with_folders(paths)
    told = _matched(every, parsed(files))
    gone = told.where("is_folder AND ignored").select(F.col("path").alias("above"))
    own = told.where("NOT is_folder")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = own.where(F.contains("path", F.lit("/"))).select("path", F.explode(above).alias("above")).join(gone, "above").select("path").distinct()
    return own.join(inside.withColumn("inside", F.lit(True)), "path", "left").select("path", (F.col("ignored") | F.coalesce("inside", F.lit(False))).alias("ignored"))
