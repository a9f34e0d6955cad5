"""What the training-data operators share: shared-folder tables, Arrow maps, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: with texts of a few kB this keeps a Python worker far below 100 MB.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch of packed blocks, of which a row has some MB (a batch has one row at least).
PACKED_BYTES = 8 << 20
#: Blocks of a file.
FILE_BLOCKS = 8


def workdir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one
    process (tests). On a cluster an executor's own disk is no such folder, so the setting is needed there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='skein-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/skein/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Written once to the shared folder and read again: later steps do not depend on executors that may be lost.

    file_rows: rows of a file at most (0: any), for rows of some MB: the reader holds thousands of a file's rows at once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows of Arrow batches by memory. Spark reads the setting when a query runs, so it stays set: it changes
    how much a Python worker holds at once, and no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def packed_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, too: else a batch of blocks is as large as the split of the file they are read
    from, which grows with the input. Stays set like `small_batches`, and changes no result."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PACKED_BYTES))


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str, make: Callable[[], dict], name: str = "") -> dict:
    """A cache of this worker, for one owner at a time: workers live on across stages, so others' caches are let go."""
    if owner not in _CACHES:
        _CACHES.clear()
        _CACHES[owner] = {}
    own = _CACHES[owner]
    if name not in own:
        own[name] = make()
    return own[name]


def arrow_map(df: DataFrame, rows_of: Callable[[Iterator[dict]], Iterator[dict]], schema: StructType) -> DataFrame:
    """rows_of gets an iterator over batches (name -> Python list) and yields batches of the same kind (lists or arrays)."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows_of(b.to_pydict() for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and text (null: empty); other columns are left out, so their names cannot clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), *[docs[c] for c in also])


#: ASCII upper-case letters to lower case; other letters stay.
LOWER = {i: i + 32 for i in range(65, 91)}
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def lower_column(c: Column) -> Column:
    return F.translate(c, UPPER_ASCII, LOWER_ASCII)


#: White space of the word pattern [^\x20\x09-\x0D]+ ; others of str.split() are word characters.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
_SPLIT_ASCII = None


def plain_words(text: str) -> list[str]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, by str.split() where it gives the same."""
    global _SPLIT_ASCII
    if _SPLIT_ASCII is None:
        import re

        _SPLIT_ASCII = (re.compile(f"[{_OTHER_SPACE}]").search, re.compile("[^\x20\x09-\x0d]+").findall)
    return _SPLIT_ASCII[1](text) if _SPLIT_ASCII[0](text) else text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
