"""Change sets by folder hashes: a tracker that opens only the folders in which something differs.

A folder's hash is a sum, over all files below it, of two 64-bit hashes of path and content hash, with their number, so all
folders' hashes come from one grouping and no order matters. Trees are compared from the top: the folders of a level are
looked at where the folder above differs, and the stored rows of a level are a bucket of their own. Of the stored tracker, laid
out by folder, only the buckets are opened that hold a differing folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.store import Store, change_set

TREE, FILES = "tree", "tracker-by-folder"
_TREE = "folder string, above string, bucket int, files long, h1 decimal(38,0), h2 decimal(38,0)"
_FILES = "rel_path string, file_hash string, folder string, bucket int"


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def folder_hashes(files: DataFrame) -> DataFrame:
    """folder ('' at the top), above, bucket (its depth), files, h1, h2 of every folder with files below. files: rel_path, file_hash."""
    parts = F.split("rel_path", "/")
    up = F.concat(F.array(F.struct(F.lit("").alias("folder"), F.lit(0).alias("bucket"))), F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("bucket"))))
    up = F.when(F.contains("rel_path", F.lit("/")), up).otherwise(F.slice(up, 1, 1))
    h = lambda seed: F.xxhash64("rel_path", F.coalesce("file_hash", F.lit("")), F.lit(seed)).cast("decimal(38,0)").alias(f"h{seed}")
    own = files.where("rel_path IS NOT NULL").select(h(1), h(2), F.explode(up).alias("x")).select("x.*", "h1", "h2")
    summed = own.groupBy("folder", "bucket").agg(F.count("*").alias("files"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("h1", "h2")])
    above = F.when(F.col("bucket") > 0, _folder(F.col("folder")))
    return summed.select("folder", above.alias("above"), "bucket", "files", "h1", "h2")


class FolderTracker:
    """The tracker of a collection, by folder."""

    def __init__(self, store: Store, collection: str, buckets: int = 64):
        self.store, self.collection, self.buckets = store, collection, buckets
        self.opened = 0  # buckets of files that the last comparison has opened

    def _placed(self, files: DataFrame) -> DataFrame:
        folder = _folder(F.col("rel_path"))
        return files.where("rel_path IS NOT NULL").select("rel_path", "file_hash", folder.alias("folder"), F.pmod(F.xxhash64(folder), F.lit(self.buckets)).cast("int").alias("bucket"))

    def write(self, files: DataFrame) -> None:
        """The state from now on: rel_path, file_hash of all files."""
        change = self.store.change(self.collection)
        change.write(folder_hashes(files), TREE)
        change.write(self._placed(files), FILES)
        change.commit()

    def differing(self, files: DataFrame) -> DataFrame:
        """folder of the folders below which something differs from the stored state, level by level from the top."""
        change = self.store.change(self.collection)
        tree = folder_hashes(files).persist()  # a row a folder
        stored = change.tables.get(TREE)
        depths = sorted({int(k) for k in (stored["parts"] if stored else {})} | {r[0] for r in tree.select("bucket").distinct().collect()})
        out, above = None, None
        for d in depths:
            now, old = tree.where(F.col("bucket") == d), change.read(TREE, _TREE, buckets=[d])
            if above is not None:
                now, old = (x.join(above.withColumnRenamed("folder", "above"), "above", "left_semi") for x in (now, old))
            sides = [x.select("folder", F.struct("files", "h1", "h2").alias(n)) for x, n in ((now, "now"), (old, "old"))]
            above = sides[0].join(sides[1], "folder", "full_outer").where(~F.col("now").eqNullSafe(F.col("old"))).select("folder").persist()
            if above.isEmpty():
                break
            out = above if out is None else out.unionByName(above)
        return self.store.spark.createDataFrame([], "folder string") if out is None else out

    def change_set(self, files: DataFrame) -> DataFrame:
        """As store.change_set of the files and the stored state."""
        folders = self.differing(files).persist()
        buckets = sorted(r[0] for r in folders.select(F.pmod(F.xxhash64("folder"), F.lit(self.buckets)).cast("int")).distinct().collect())  # at most self.buckets
        self.opened = len(buckets)
        old = self.store.read(self.collection, FILES, _FILES, buckets=buckets).join(folders, "folder", "left_semi")
        return change_set(self._placed(files).join(folders, "folder", "left_semi"), old)
