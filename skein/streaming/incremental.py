"""An extension: files that arrive in a folder are upserted into a collection as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import embed
from skein.operators.chunking import chunk_files
from skein.sources.store import Store

FILES = "rel_path string, language string, file_hash string, content string"


def upsert_stream(spark: SparkSession, arriving: str, store: Store, collection: str, checkpoint: str, profile: str = "hashing-tf") -> StreamingQuery:
    """Parquet files of FILES rows in `arriving`; each micro-batch replaces the chunks of its files, in their buckets only,
    and their rows of the tracker, in one commit. Of several rows of a file the last by hash counts. Chunks are embedded by
    the collection's profile, or by `profile` where it has no manifest. A micro-batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        change = store.change(collection)
        known = change.read("manifest")
        own = known.first()["profile"] if known is not None else profile
        files = batch.groupBy("rel_path").agg(F.max_by(F.struct("language", "file_hash", "content"), "file_hash").alias("f")).select("rel_path", "f.*")
        files = files.persist()  # one micro-batch, read by two tables
        changed = files.select(F.col("rel_path").alias("file_path"))
        change.replace_files(changed, chunk_files(files).withColumn("embedding", embed.embed(F.col("source"), own)))
        old = change.read("tracker", "rel_path string, file_hash string")
        change.write(old.join(files.select("rel_path"), "rel_path", "left_anti").unionByName(files.select("rel_path", "file_hash")), "tracker")
        change.commit()
        files.unpersist()

    return spark.readStream.schema(FILES).parquet(arriving).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
