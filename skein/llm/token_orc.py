"""Operator 7: token ids as ORC with integer run-length encoding, row indexes and Bloom filters on doc_id.

Texts are dealt by ranges of doc_id and sorted, so files and stripes hold disjoint ranges and a reader prunes by
statistics (ranges) or Bloom filters (points). Each file can be read by stripes in parallel; every row carries its
file's number and the count of ids before it in that file, so a document's place in the whole follows from one sum
per file.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows with one doc_id stand in
any order, one after the other, in as many files as their texts' hashes are dealt to; texts of any length are encoded whole;
an empty table gives no rows; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.llm.common import doc_texts, new_path, small_batches
from skein.llm.tokens import encode

END = 2
STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])
#: Bytes of text that a file takes, about; files up to which their sums are broadcast (1.6 MB).
FILE_CHARS, BROADCAST_FILES = 64_000_000, 100_000
ORC = {"orc.compress": "ZSTD", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}


def write(docs: DataFrame, out: str, path: str, partitions: int | None = None) -> None:
    """Encodes every text and writes ORC files in ascending doc_id order."""
    small_batches(docs.sparkSession, 500)
    texts = doc_texts(docs)
    if partitions is None:
        row = texts.agg(F.sum(F.length("text")).alias("n")).first()
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(row["n"] or 0) // FILE_CHARS))
    target, end = to_arrow_schema(STORED), np.array([END], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            raw = [x + end for x in encode(b.column("text").to_pylist(), path)]
            counts = np.array([len(x) // 4 for x in raw], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(raw), part, np.int32)), pa.array(done + offsets[:-1]), pa.array(counts), ids.cast(target.field("ids").type)], schema=target)
            done += int(offsets[-1])

    # rows of one id, or without any, are dealt by their text as well, so that they are no single task
    ordered = texts.repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(rows, STORED).write.options(**ORC).orc(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the predicate prunes files, stripes and row groups by statistics and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def with_starts(stored: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: one sum per file, from the short columns alone.

    The driver sees 16 bytes a file; they come back by a join, broadcast up to BROADCAST_FILES of them.
    """
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).toArrow().sort_by("part")
    ends = np.cumsum(sums.column("n").to_numpy())
    base = pa.table({"part": sums.column("part"), "before": np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)})
    files = stored.sparkSession.createDataFrame(base, "part int, before long")
    joined = stored.join(F.broadcast(files) if len(ends) <= BROADCAST_FILES else files, "part")
    return joined.withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Writes the files, reads them back and returns doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    write(docs, out := new_path(spark, "ids"), path)
    stored = with_starts(read(spark, out))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            raw, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            sums = [zlib.crc32(raw[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], schema=target)

    return stored.select("doc_id", "start", "ids").mapInArrow(rows, schema)
