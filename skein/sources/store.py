"""Collections of tables as Parquet snapshots with one pointer, change sets, tracker, manifest, statistics by bucket."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

#: The column whose hash deals rows to buckets.
BY = "file_path"
#: Size of the sketches of distinct files (2^12 registers).
SKETCH_BITS = 12
STATS = "bucket int, chunk_type string, n long, files binary"


def bucket_of(buckets: int) -> Column:
    """The bucket that a row's file path deals it to."""
    return F.pmod(F.xxhash64(BY), F.lit(buckets)).alias("bucket")


def change_set(current: DataFrame, stored: DataFrame) -> DataFrame:
    """rel_path, status (added, modified, deleted), old_hash, new_hash; unchanged files are left out."""
    both = current.select("rel_path", F.col("file_hash").alias("new_hash")).join(stored.select("rel_path", F.col("file_hash").alias("old_hash")), "rel_path", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.withColumn("status", status).where("status IS NOT NULL").select("rel_path", "status", "old_hash", "new_hash")


def change_totals(changes: DataFrame) -> DataFrame:
    """added, deleted, modified, total of a change set."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(n("added"), n("deleted"), n("modified"), F.count("*").alias("total"))


def manifest_status(wanted: DataFrame, manifests: DataFrame) -> DataFrame:
    """collection, status (indexed, missing) and the manifest's columns for every wanted collection; numbers of missing ones are 0."""
    numbers = [c for c, kind in manifests.dtypes if c != "collection" and kind in ("bigint", "int", "double")]
    both = wanted.select("collection").distinct().join(manifests.withColumn("_there", F.lit(True)), "collection", "left")
    rest = [F.coalesce(c, F.lit(0)).alias(c) if c in numbers else F.col(c) for c in manifests.columns if c != "collection"]
    return both.select("collection", F.when(F.col("_there").isNull(), "missing").otherwise("indexed").alias("status"), *rest)


def keep_first(chunks: DataFrame, key: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    return chunks.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def repeats(chunks: DataFrame, key: str = "chunk_id") -> bool:
    """Whether a key stands more than once; no other column is shuffled."""
    return not chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace those of the same key; within the new ones the first stays."""
    fresh = keep_first(new, key)
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def without_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("file_path").distinct(), "file_path", "left_anti")


def stats(chunks: DataFrame) -> DataFrame:
    """Exact counts by chunk type."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def summaries(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk_type, n, files (sketch of the distinct files): what can be merged without reading the chunks again."""
    kind = F.coalesce(F.col("chunk_type"), F.lit("")).alias("chunk_type")
    return chunks.groupBy(bucket_of(buckets), kind).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.coalesce(BY, F.lit("")), F.lit(SKETCH_BITS)).alias("files"))


def merged(summary: DataFrame, *by: str) -> DataFrame:
    """Summaries of any buckets as one: n is exact, files an estimate (1.6 % or so at SKETCH_BITS 12)."""
    return summary.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("files")), F.lit(0)).alias("files"))


class ConcurrentWrite(RuntimeError):
    """Another writer has moved the pointer since this one read it; nothing of this write is visible."""


class Change:
    """Tables of a collection, written beside its current state; commit() makes all of them visible at once.

    Until then readers see the old state of every table, and a change that is never committed leaves nothing but folders
    that vacuum() removes. read() sees what this change has written.
    """

    def __init__(self, store: Store, collection: str):
        self.store, self.collection, self.spark = store, collection, store.spark
        self.last, self.tables = store._state(collection)

    def _open(self, table: str, schema: StructType, parts: list[str]) -> DataFrame:
        paths = [f"{self.store.root}/{self.collection}/{table}/{x}" for x in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str = "chunks", schema: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or of it the named buckets only; None (an empty table where a schema is given) if it is not there."""
        now = self.tables.get(table)
        if now is None:
            return self.spark.createDataFrame([], schema) if schema else None
        parts = now["parts"] or {}
        wanted = parts if buckets is None or not now["buckets"] else {k: v for k, v in parts.items() if int(k) in set(buckets)}
        return self._open(table, StructType.fromJson(json.loads(now["schema"])), sorted(wanted.values()))

    def _put(self, table: str, df: DataFrame, buckets: int, row_group: int | None = None) -> dict[str, str]:
        """Writes rows beside what is there; their parts. Rows keep the order of their partitions within a part."""
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.store.root}/{self.collection}/{table}/{version}"
        if not buckets:
            df.write.parquet(path)
            return {"": version}
        dealt = df.withColumn("bucket", bucket_of(buckets)) if buckets > 0 else df
        placed = dealt.withColumn("_part", F.col("bucket")).drop(*["bucket"] * (buckets > 0)).repartition("_part")
        if row_group:  # rows of small groups stand in order, so that a filter passes over most of them
            writer = placed.sortWithinPartitions("_part", "block").write.option("parquet.block.size", row_group)
        else:
            writer = placed.write
        writer.partitionBy("_part").parquet(path)
        return {x.removeprefix("_part="): f"{version}/{x}" for x in self.store._names(path) if x.startswith("_part=")}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again: for what several tables are made of. No table; vacuum() removes it."""
        return self._open(name, df.schema, [*self._put(name, df, 0).values()])

    def _set(self, table: str, schema: StructType, buckets: int, parts: dict[str, str]) -> None:
        self.tables = self.tables | {table: {"schema": schema.json(), "buckets": buckets, "parts": parts}}

    def write(self, df: DataFrame, table: str = "chunks", row_group: int | None = None) -> None:
        """The whole table anew. Rows with a file path are laid out by its hash, rows that carry a number `bucket` by that; with
        row_group, sorted by their column `block` in row groups of so many bytes."""
        now = self.tables.get(table)
        buckets = OWN if "bucket" in df.columns else 0 if BY not in df.columns else now["buckets"] if now and now["buckets"] > 0 else self.store.buckets
        parts = self._put(table, df, buckets, row_group)
        self._set(table, df.schema, buckets, parts)
        self._summarise(table, df.schema, buckets, parts, None)

    def replace_buckets(self, df: DataFrame, touched: set[int], table: str, row_group: int | None = None) -> None:
        """The touched buckets of a table laid out by `bucket` hold these rows from now on, the others what they held."""
        now = self.tables.get(table)
        kept = {k: v for k, v in (now["parts"] if now else {}).items() if int(k) not in touched}
        self._set(table, df.schema if now is None else StructType.fromJson(json.loads(now["schema"])), OWN, kept | self._put(table, df, OWN, row_group))

    def replace_files(self, changed: DataFrame, new: DataFrame, table: str = "chunks") -> set[int]:
        """The rows of the changed files (file_path) are replaced by the new ones, all of them of changed files; of equal
        chunk_ids the first stays. A table without buckets is written whole. The numbers of the buckets it rewrote."""
        now = self.tables.get(table)
        fresh = keep_first(new) if repeats(new) else new  # whole rows are dealt by chunk_id only where some would go
        if now is None or now["buckets"] <= 0:
            old = self.read(table)
            self.write(fresh if old is None else without_files(old, changed).unionByName(fresh), table)
            return {int(k) for k in self.tables[table]["parts"] if k}
        touched = {r[0] for r in changed.select(bucket_of(now["buckets"])).distinct().collect()}  # numbers of buckets
        schema, parts = StructType.fromJson(json.loads(now["schema"])), now["parts"] or {}
        put = self._put(table, without_files(self.read(table, buckets=list(touched)), changed).unionByName(fresh).select(*schema.names), now["buckets"])
        self._set(table, schema, now["buckets"], {k: v for k, v in parts.items() if int(k) not in touched} | put)
        self._summarise(table, schema, now["buckets"], put, touched)
        return touched

    def _summarise(self, table: str, schema: StructType, buckets: int, parts: dict[str, str], touched: set[int] | None) -> None:
        """Keeps the statistics of what was just written: two of its columns are read back."""
        if buckets <= 0 or not {BY, "chunk_type"} <= set(schema.names):
            return
        told = summaries(self._open(table, schema, sorted(parts.values())).select(BY, "chunk_type"), buckets)
        name = f"{table}-stats"
        if touched is None or name not in self.tables:
            self.write(told if touched is None else summaries(self.read(table).select(BY, "chunk_type"), buckets), name)
        else:
            self.replace_buckets(told, touched, name)

    def drop(self, table: str) -> bool:
        there = table in self.tables
        self.tables = {k: v for k, v in self.tables.items() if k != table}
        return there

    def commit(self) -> None:
        self.store._point(self.collection, self.last + 1, self.tables)


#: Layout of a table whose rows carry their bucket.
OWN = -1


class Store:
    """One folder per collection, with one for each table's snapshots v-*, and numbered pointer files: each names the parts of
    all tables of one state.

    Chunks lie in buckets of their file's path, so a change rewrites only the buckets of the files it touches and the next
    pointer names the others where they are. The number of buckets is fixed when a collection is first written; take about
    one for each GB. A pointer is written aside and moved to its name, which no file may have yet: it is whole when it can
    be seen, a lost writer leaves nothing in the way, and of two writers one gets ConcurrentWrite.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _state(self, collection: str) -> tuple[int, dict[str, dict]]:
        """The highest number that a pointer file has, and the tables of the last one that is a pointer."""
        path = f"{self.root}/{collection}/pointer"
        names = [x for x in self._names(path) if x.removesuffix(".json").isdigit()]
        last = int(names[-1].removesuffix(".json")) if names else 0
        for x in reversed(names):
            fs, p = self._fs(f"{path}/{x}")
            stream = fs.open(p)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return last, json.loads(text)["tables"]
            except (ValueError, KeyError, TypeError):
                continue  # no pointer, whatever it is
        return last, {}

    def _entry(self, collection: str, table: str) -> dict | None:
        last, tables = self._state(collection)
        return tables[table] | {"n": last} if table in tables else None

    def _point(self, collection: str, n: int, tables: dict[str, dict]) -> None:
        jvm, folder = self.spark._jvm, f"{self.root}/{collection}/pointer"
        fs, aside = self._fs(f"{folder}/.{n:012d}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"n": n, "tables": tables}).encode() + b"\n"))
        out.close()
        aside, whole = (fs.makeQualified(p) for p in (aside, self._fs(f"{folder}/{n:012d}.json")[1]))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, whole, how)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception):
                raise ConcurrentWrite(f"{collection} was written by another writer") from None
            raise

    def change(self, collection: str) -> Change:
        return Change(self, collection)

    def read(self, collection: str, table: str = "chunks", schema: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The current snapshot, or None (an empty table where a schema is given): reading creates nothing."""
        return self.change(collection).read(table, schema, buckets)

    def write(self, collection: str, df: DataFrame, table: str = "chunks") -> None:
        """A new snapshot beside the one that may be read by df; the pointer moves when it is whole."""
        change = self.change(collection)
        change.write(df, table)
        change.commit()

    def replace_files(self, collection: str, changed: DataFrame, new: DataFrame, table: str = "chunks") -> None:
        change = self.change(collection)
        change.replace_files(changed, new, table)
        change.commit()

    def lookup(self, collection: str, rows: DataFrame, *columns: str, table: str = "chunks") -> DataFrame:
        """rows (chunk_id, ...) with columns of their chunks. Only the buckets that the chunk_ids' files lie in are opened, as
        a chunk_id begins with its file's path; of them only these columns, and Spark filters them by the few ids."""
        now = self._entry(collection, table)
        if now is None:
            raise ValueError(f"no table {table} in {collection}")
        buckets = None
        if now["buckets"] > 0:
            path = rows.select(F.regexp_replace("chunk_id", ":[^:]*$", "").alias(BY))
            buckets = [r[0] for r in path.select(bucket_of(now["buckets"])).distinct().collect()]  # at most the table's buckets
        return rows.join(self.read(collection, table, buckets=buckets).select("chunk_id", *columns), "chunk_id")

    def statistics(self, collection: str, *by: str, table: str = "chunks") -> DataFrame:
        """n and files (an estimate) of a table, by chunk_type or as a whole, from the buckets' summaries."""
        return merged(self.read(collection, f"{table}-stats", STATS), *by)

    def vacuum(self, collection: str) -> int:
        """Removes what the current state does not name; how many folders went. No one may read or write an older state."""
        last, tables = self._state(collection)
        path, gone = f"{self.root}/{collection}", []
        if not tables:
            return 0
        for table in [t for t in self._names(path) if t != "pointer"]:
            used = set((tables.get(table, {}).get("parts") or {}).values())
            for x in [n for n in self._names(f"{path}/{table}") if n.startswith("v-")]:
                own = [f"{x}/{b}" for b in self._names(f"{path}/{table}/{x}") if b.startswith("_part=")]
                if x not in used:
                    gone += [f"{table}/{b}" for b in own if b not in used] if any(b in used for b in own) else [f"{table}/{x}"]
        current = max((x for x in self._names(f"{path}/pointer") if x.removesuffix(".json").isdigit()), default="")
        for x in [*gone, *[f"pointer/{n}" for n in self._names(f"{path}/pointer") if n != current]]:
            fs, p = self._fs(f"{path}/{x}")
            fs.delete(p, True)
        return len(gone)

    def delete(self, collection: str) -> bool:
        fs, p = self._fs(f"{self.root}/{collection}")
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def drop(self, collection: str, table: str) -> bool:
        """Forgets one table; the others stay."""
        change = self.change(collection)
        there = change.drop(table)
        if there:
            change.commit()
        return there

    def collections(self) -> list[str]:
        return self._names(self.root)

    def everywhere(self, table: str, schema: str) -> DataFrame:
        """A table of all collections, read as one."""
        paths = [f"{self.root}/{c}/{table}/{x}" for c in self.collections() for x in ((self._state(c)[1].get(table) or {}).get("parts") or {}).values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
