"""Approximate vector search by an inverted file of k-means cells, and the exact search that the same file allows.

Vectors lie in a table of a collection laid out by their cell (the nearest centre by angle). A query opens the folders of the
cells it probes and of no others, and a vector meets only the queries that probe its cell. Centres come from a bounded
sample; every vector is indexed. With `certain`, cells are opened until none that remains can hold a nearer vector: the angle
between a query and a cell's members is at least that to its centre less the cell's radius. Changed files rewrite only the
cells that lose or gain vectors. Rows may carry any metadata, which a filter is pushed down to.

A vector that is null, holds a null or has another dimension than the centres is in no cell; a query without a vector has no
hits. Ties go by chunk_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from skein.operators.topk import first_of_each
from skein.operators.vectors import ROUND, ROUND_BYTES, unit
from skein.sources.store import Change, Store

#: Vectors that centres are fitted on, rounds of k-means, cells at most, and vectors of a cell on average below that.
SAMPLE, ROUNDS, MOST_CELLS, CELL_VECTORS = 16_384, 8, 1024, 64
#: Stored vectors that the number of probes is tuned on, and hits that a task holds before it keeps the best.
TUNE_QUERIES, HELD = 128, 500_000
CENTRES = "cell int, centre array<double>, radius double, n long"
SLACK = 2e-6


def _whole(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of the dimension without nulls, at length 1."""
    good = vectors.where((F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull()))
    return good.withColumn("embedding", unit(F.col("embedding")))


def fitted(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres at length 1 of a sample by hash of the id. vectors: chunk_id, embedding at length 1."""
    got = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
    x = np.array([r["embedding"] for r in got], float)
    centres = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(ROUNDS if len(x) else 0):
        own = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = x[own == c].sum(0)
            centres[c] = mean / n if (n := np.linalg.norm(mean)) > 0 else centres[c]
    return centres


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors (embedding at length 1) with bucket: the nearest cell; and angle: to its centre."""
    names = [f.name for f in vectors.schema]
    schema = StructType([*vectors.schema, StructField("bucket", LongType())]).add("angle", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(names.index("embedding")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = x @ centres.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(angle)], [*names, "bucket", "angle"])

    return vectors.mapInArrow(run, schema)


class Cells:
    """The cells of a collection: its table `cells` (rows by cell) and `centres` (at most MOST_CELLS rows)."""

    def __init__(self, store: Store, collection: str):
        self.store, self.collection, self.opened = store, collection, 0  # folders of cells that the last search has opened

    def _centres(self, change: Change) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = change.read("centres", CENTRES).orderBy("cell").collect()
        return np.array([r["centre"] for r in rows], float), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """vectors: chunk_id, embedding and any metadata. About a cell for each CELL_VECTORS vectors, MOST_CELLS at most."""
        change = self.store.change(self.collection)
        seen = vectors.where("embedding IS NOT NULL").agg(F.count("*").alias("n"), F.mode(F.size("embedding"), True).alias("d")).first()
        rows = _whole(vectors, seen["d"] or 0)
        centres = fitted(rows.select("chunk_id", "embedding"), cells or max(1, min(MOST_CELLS, seen["n"] // CELL_VECTORS)))
        change.write(assigned(rows, centres), "cells")
        self._describe(change, centres)
        change.commit()

    def _describe(self, change: Change, centres: np.ndarray) -> None:
        told = {r["bucket"]: r for r in change.read("cells").groupBy("bucket").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect()}
        rows = [(c, [float(x) for x in centres[c]], float(told[c]["a"]) if c in told else 0.0, told[c]["n"] if c in told else 0) for c in range(len(centres))]
        change.write(self.store.spark.createDataFrame(rows, CENTRES), "centres")

    def replace_files(self, changed: DataFrame, new: DataFrame) -> set[int]:
        """The vectors of the changed files (file_path, a metadata column) are replaced by new ones; the cells rewritten."""
        change = self.store.change(self.collection)
        centres, _, _ = self._centres(change)
        table = change.read("cells")
        gone = changed.select("file_path").distinct()
        fresh = assigned(_whole(new, centres.shape[1]), centres).select(*table.columns)
        old = table.select("bucket", "file_path").join(gone, "file_path", "left_semi").select("bucket")
        touched = {int(r[0]) for r in old.unionByName(fresh.select("bucket")).distinct().collect()}  # numbers of cells
        kept = change.read("cells", buckets=sorted(touched)).join(gone, "file_path", "left_anti").select(*table.columns)
        change.replace_buckets(kept.unionByName(fresh), touched, "cells")
        self._describe(change, centres)
        change.commit()
        return touched

    def search(self, queries: DataFrame, k: int = 8, probes: int | None = None, where: Column | str | None = None, certain: bool = False) -> DataFrame:
        """query_id, chunk_id, distance, rank of the k nearest of the vectors that pass `where`, in the cells probed: the
        `probes` nearest to each query, or as many as tuned() finds enough; with `certain` in all that may hold one."""
        change = self.store.change(self.collection)
        centres, radius, sizes = self._centres(change)
        table = change.read("cells")
        known = queries.where((F.size("embedding") == centres.shape[1]) & ~F.exists("embedding", lambda x: x.isNull())).select("query_id", unit(F.col("embedding")).alias("embedding"))
        rounds = max(1, -(-known.count() * centres.shape[1] * 8 // ROUND_BYTES))
        probes = probes or (max(1, len(centres) // 8) if certain else self.tuned(k))
        found, self.opened = None, 0
        for r in range(rounds):
            got = (known if rounds == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)).orderBy("query_id").collect()  # ROUND_BYTES
            if not got:
                continue
            ids, q = [x["query_id"] for x in got], np.array([x["embedding"] for x in got], float)
            angle = np.arccos(np.clip(q @ centres.T, -1, 1))
            wanted = np.zeros(angle.shape, bool)
            np.put_along_axis(wanted, np.argsort(angle, 1, kind="stable")[:, :probes], True, 1)
            wanted &= sizes > 0
            hits = self._compare(change, table, ids, q, wanted, k, where, dict(queries.dtypes)["query_id"])
            if certain:
                hits = hits.persist()  # k rows a query, read twice
                last = {x["query_id"]: x["d"] for x in hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("d")).collect()}
                kth = np.array([last.get(i, np.inf) for i in ids])
                nearest = 1 - np.cos(np.maximum(0, angle - radius))
                more = (nearest <= kth[:, None] + SLACK) & ~wanted & (sizes > 0)
                if more.any():
                    hits = _ranked(hits.drop("rank").unionByName(self._compare(change, table, ids, q, more, k, where, dict(queries.dtypes)["query_id"]).drop("rank")), k)
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return queries.select("query_id").limit(0).crossJoin(table.select("chunk_id").limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return found

    def _compare(self, change: Change, table: DataFrame, ids: list, q: np.ndarray, wanted: np.ndarray, k: int, where, query_type: str) -> DataFrame:
        """The k best of each query in the cells it wants."""
        opened = np.flatnonzero(wanted.any(0)).tolist()
        self.opened += len(opened)
        rows = change.read("cells", buckets=opened)
        rows = rows if where is None else rows.where(where)
        kinds = f"query_id {query_type}, chunk_id {dict(table.dtypes)['chunk_id']}, distance double"
        schema = StructType.fromDDL(kinds)
        types = [to_arrow_type(schema[c].dataType) for c in ("query_id", "chunk_id")]
        sent = self.store.spark.sparkContext.broadcast((ids, q, {c: np.flatnonzero(wanted[:, c]) for c in opened}))  # ROUND_BYTES and a bit a query and cell

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asking = sent.value
            held, count = [], 0

            def best() -> tuple:
                all_ = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                keep = first_of_each(*all_, k)
                return tuple(x[keep] for x in all_)

            for b in batches:
                cell = b.column("bucket").to_numpy()
                x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
                own = b.column("chunk_id").to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    of, at = asking[c], np.flatnonzero(cell == c)
                    d = np.round(1 - q[of] @ x[at].T, ROUND) + 0.0
                    if len(at) > k:
                        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
                    else:
                        row, col = np.nonzero(np.ones(d.shape, bool))
                    held.append((of[row], d[row, col], own[at][col]))
                    count += len(row)
                if count > HELD:
                    held = [best()]
                    count = len(held[0][0])
            if held:
                query, value, ident = best()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in query.tolist()], types[0]), pa.array(ident, types[1]), pa.array(value)], ["query_id", "chunk_id", "distance"])

        return _ranked(rows.select("bucket", "chunk_id", "embedding").mapInArrow(run, kinds), k)

    def tuned(self, k: int = 8, share: float = 0.95) -> int:
        """Probes that find `share` of the k nearest of a sample of stored vectors (TUNE_QUERIES by hash), themselves left out."""
        change = self.store.change(self.collection)
        centres, _, _ = self._centres(change)
        sample = change.read("cells").select(F.col("chunk_id").alias("query_id"), "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(TUNE_QUERIES)
        asked = {r["query_id"]: np.array(r["embedding"]) for r in sample.collect()}
        hits = self.search(self.store.spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], sample.schema), k + 1, certain=True).where("query_id <> chunk_id")
        placed = hits.join(change.read("cells").select("chunk_id", "bucket"), "chunk_id").select("query_id", "bucket").collect()
        ranks = sorted(int(np.flatnonzero(np.argsort(-(centres @ asked[r["query_id"]]), kind="stable") == r["bucket"])[0]) + 1 for r in placed)
        return ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)] if ranks else 1


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "chunk_id"))).where(F.col("rank") <= k)
