"""Operator 11: hard negatives by one-dimensional distance keys.

Vectors of integers are augmented by sqrt(M - |x|^2), M the greatest squared length, so that a greater inner product with a
query is a smaller distance: d^2 = |q|^2 + M - 2 score. Every vector goes to its nearest pivot and is stored sorted by
(pivot, distance) in chunks; a cell is a ring of distances around a pivot. A distance to the query is at least the gap
between the query's distance to the pivot and the ring, and at most their sum. A search takes the cells of least bound
first, widens the interval of keys round by round, and ends for a query as soon as the bound of all cells that remain is
beyond its k-th hit, so results are exact. Positives are searched from distance 0 among rows of the anchor's label, and
negatives outwards from the annulus of scores that each positive allows.

Pivots come from a sample (PIVOT_SAMPLE rows by hash of the id, k-means); every row is indexed. The directory of cells has
at most PIVOTS * RINGS rows, whatever the input; chunks, blocks of queries and what meets in one task are bounded. Hits are
ranked by a window of which every task keeps k rows a query.

Defined results: rows without an id take no part; of equal rows (id, label, vector) one counts; rows of one id that differ
are rows of their own, and an anchor's other rows are those of another id; shorter vectors count as padded by zeros; a vector
whose integers' squared length is 2^62 or more takes no part, since no long holds its scores; an empty table gives an empty
one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.llm.common import staged
from skein.operators.topk import first_of_each

ANCHOR_EVERY, FLIP_EVERY, LABELS, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
PIVOTS, PIVOT_SAMPLE, KMEANS_ROUNDS = 32, 4096, 8
#: Rings of a pivot at most, and rows that one should have at least.
RINGS, RING_ROWS = 64, 512
#: Rows of a chunk, chunks that meet a block of queries in one task, queries of a block and of one matrix product.
CHUNK_ROWS, TASK_CHUNKS, BLOCK, PRODUCT = 2048, 8, 16384, 512
#: Parts in which the chunks of a cell meet the blocks that ask for it.
SALTS = 8
#: Share of the rows that a first interval covers.
FIRST_SHARE = 16
#: Against rounding of distances.
SLACK = 1e-6
_NONE, _ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max

VECTORS = "vec_id long, label long, n2 long, v binary"
PLACED = "pivot int, dist double, vec_id long, label long, n2 long, v binary"
CHUNKS = "cell int, chunk long, rows int, dim int, lo double, hi double, ids binary, labels binary, vectors binary"
QUERIES = "block int, dim int, ids binary, labels binary, n2 binary, vectors binary, low binary, high binary, slots int"
STATE = QUERIES + ", seen binary, kth binary"
HITS = "block int, q int, slot int, vec_id long, score long"


def _map(df: DataFrame, rows_of, schema: str) -> DataFrame:
    return df.mapInPandas(rows_of, schema)


def quantised(embeddings: DataFrame) -> DataFrame:
    """VECTORS of the rows that take part: labels after the flip, floor(256 x) as packed int32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"vec_id": [], "label": [], "n2": [], "v": []}
            for i, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = x.values
                if i is None or label is None or x is None or x.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    scaled = np.floor(SCALE * np.asarray(x, float))
                    if not np.isfinite(scaled).all() or scaled @ scaled >= 2.0**62:
                        continue
                own = scaled.astype("<i4")
                out["vec_id"].append(i)
                out["label"].append(label if i % FLIP_EVERY else int(np.fmod(label + 1, LABELS)))
                out["n2"].append(int((own.astype(np.int64) ** 2).sum()))
                out["v"].append(own.tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(out["vec_id"], pa.int64()), "label": pa.array(out["label"], pa.int64()), "n2": pa.array(out["n2"], pa.int64()), "v": pa.array(out["v"], pa.binary())})

    own = embeddings.select(embeddings["vec_id"].cast("long"), embeddings["label"].cast("long"), embeddings["embedding"].cast("array<double>"))
    return own.mapInArrow(rows, VECTORS).dropDuplicates(["vec_id", "label", "v"])


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of int64, padded by zeros."""
    out = np.zeros((len(packed), dim), np.int64)
    for k, raw in enumerate(packed):
        own = np.frombuffer(raw, "<i4")
        out[k, : len(own)] = own
    return out


def _wide(packed) -> int:
    return max((len(raw) // 4 for raw in packed), default=0)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where all sums stay below 2^53."""
    dim = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, x))
    most = lambda m: float((m.astype(float) ** 2).sum(1).max(initial=0))
    if most(q) * most(x) < 2.0**104:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def _augmented(v: np.ndarray, n2: np.ndarray, most: int, dim: int) -> np.ndarray:
    out = np.zeros((len(v), dim + 1))
    out[:, : v.shape[1]] = v
    out[:, dim] = np.sqrt(np.maximum(most - n2.astype(float), 0))
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, without cancellation."""
    return np.sqrt(np.maximum(np.stack([((a - p) ** 2).sum(1) for p in b], 1), 0)) if len(a) else np.zeros((0, len(b)))


def pivots(vectors: DataFrame, most: int, dim: int) -> np.ndarray:
    """Centres of a sample of augmented vectors; some may be alike if rows are."""
    got = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect()
    x = _augmented(_matrix([r["v"] for r in got], dim), np.array([r["n2"] for r in got]), most, dim)
    centres = x[:PIVOTS].copy()
    for _ in range(KMEANS_ROUNDS):
        own = _apart(x, centres).argmin(1)
        for p in range(len(centres)):
            if (own == p).any():
                centres[p] = x[own == p].mean(0)
    return centres


def _celler(cuts: dict[int, np.ndarray]):
    """Cells, in the order of (pivot, distance), of pivots and distances."""

    def cell_of(pivot: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pivot), np.int64)
        for p in np.unique(pivot).tolist():
            own = pivot == p
            out[own] = p * RINGS + np.searchsorted(cuts[p], dist[own])
        return out

    return cell_of


class Index:
    """The stored table: chunks sorted by (pivot, distance), and the directory of their cells."""

    def __init__(self, embeddings: DataFrame):
        self.vectors = staged(quantised(embeddings), "vectors")
        seen = self.vectors.agg(F.count("*").alias("n"), F.max("n2").alias("most"), F.max(F.length("v")).alias("bytes")).first()
        self.rows, self.most, self.dim = seen["n"], seen["most"] or 0, (seen["bytes"] or 0) // 4
        self.asked = 0  # pairs of a block and a cell that searches have read
        if not self.rows:
            return
        self.centres = pivots(self.vectors, self.most, self.dim)
        self.keyed = keyed = self._keyed()
        rings = max(1, min(RINGS, self.rows // (PIVOTS * RING_ROWS)))
        cuts = {r["pivot"]: r["cuts"] for r in keyed.groupBy("pivot").agg(F.percentile_approx("dist", [k / rings for k in range(1, rings)] or [0.5], 1000).alias("cuts")).collect()}
        self.cuts = {p: np.unique(c) if rings > 1 else np.empty(0) for p, c in cuts.items()}
        order = ["pivot", "dist", "vec_id"]
        self.chunks = staged(self._chunked(keyed.repartitionByRange(*order, F.xxhash64("v")).sortWithinPartitions(*order)), "chunks")
        told = self.chunks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows")).orderBy("cell").collect()  # at most PIVOTS * RINGS rows
        self.cells = np.array([r["cell"] for r in told], np.int64)
        self.lo, self.hi, self.sizes = (np.array([r[k] for r in told], float) for k in ("lo", "hi", "rows"))

    def _keyed(self) -> DataFrame:
        centres, most, dim = self.centres, self.most, self.dim

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    d = _apart(_augmented(_matrix(list(b["v"]), dim), b["n2"].to_numpy(), most, dim), centres)
                    yield b.assign(pivot=d.argmin(1).astype(np.int32), dist=d.min(1))[["pivot", "dist", "vec_id", "label", "n2", "v"]]

        return staged(_map(self.vectors, rows, PLACED), "keyed")

    def _chunked(self, ordered: DataFrame) -> DataFrame:
        cell_of = _celler(self.cuts)

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            rest = None
            for b in batches:
                b = b if rest is None else pd.concat([rest, b], ignore_index=True)
                cell = cell_of(b["pivot"].to_numpy(), b["dist"].to_numpy())
                at = [0]
                while at[-1] < len(b):  # a chunk ends where its cell does, or is full
                    own = cell[at[-1]]
                    at.append(min(at[-1] + CHUNK_ROWS, int(np.searchsorted(cell, own, side="right"))))
                rest = b.iloc[at[-2] :] if len(at) > 1 else None
                for a, z in zip(at[:-2], at[1:-1], strict=True):
                    yield packed(b.iloc[a:z], cell[a], number)
                    number += 1
            if rest is not None and len(rest):
                yield packed(rest, cell_of(rest["pivot"].to_numpy(), rest["dist"].to_numpy())[0], number)

        def packed(b: pd.DataFrame, cell: int, number: int) -> pd.DataFrame:
            dim = _wide(b["v"])
            return pd.DataFrame({"cell": [cell], "chunk": [number], "rows": [len(b)], "dim": [dim], "lo": [b["dist"].iloc[0]], "hi": [b["dist"].iloc[-1]], "ids": [b["vec_id"].to_numpy("<i8").tobytes()], "labels": [b["label"].to_numpy("<i8").tobytes()], "vectors": [_matrix(list(b["v"]), dim).astype("<i4").tobytes()]})

        return _map(ordered, rows, CHUNKS)

    def blocks(self, anchors: DataFrame) -> DataFrame:
        """QUERIES of the anchors (PLACED): neighbouring cells share a block, and a cell of many anchors has several."""
        cell_of = _celler(self.cuts)

        def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(cell=cell_of(b["pivot"].to_numpy(), b["dist"].to_numpy()).astype(np.int32))

        own = _map(anchors, celled, f"{PLACED}, cell int")
        counts = {r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}  # at most PIVOTS * RINGS rows
        base, parts, at, filled = {}, {}, 0, 0
        for cell, n in sorted(counts.items()):
            if filled and filled + n > BLOCK:
                at, filled = at + 1, 0
            base[cell], parts[cell] = at, -(-n // BLOCK)
            at, filled = (at + parts[cell], 0) if parts[cell] > 1 else (at, filled + n)
        dim = self.dim

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(block=[base[c] + h % parts[c] for c, h in zip(b["cell"], b["h"], strict=True)])[["block", "vec_id", "label", "n2", "v"]]

        def packed(b: pd.DataFrame) -> pd.DataFrame:
            n, b = len(b), b.sort_values(["vec_id", "v"])
            longs = {k: [b[c].to_numpy("<i8").tobytes()] for k, c in (("ids", "vec_id"), ("labels", "label"), ("n2", "n2"))}
            bounds = {"low": [np.full(n, _NONE, "<i8").tobytes()], "high": [np.full(n, _ALL, "<i8").tobytes()]}
            return pd.DataFrame({"block": [int(b["block"].iloc[0])], "dim": [dim], **longs, "vectors": [_matrix(list(b["v"]), dim).astype("<i4").tobytes()], **bounds, "slots": [1]})

        dealt = _map(own.withColumn("h", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)).cast("int")), numbered, "block int, vec_id long, label long, n2 long, v binary")
        return staged(dealt.groupBy("block").applyInPandas(packed, QUERIES), "queries")

    def _wanted(self, state: DataFrame, turn: int) -> DataFrame:
        """block, cell: what each block reads next; none where all its queries are certain."""
        cells, lo, hi, sizes, centres, most, dim = self.cells, self.lo, self.hi, self.sizes, self.centres, self.most, self.dim
        budget = self.rows / FIRST_SHARE * 4.0**turn

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    seen = np.isin(cells, np.frombuffer(r["seen"], "<i4"))
                    chosen = np.zeros(len(cells), bool)
                    n2 = np.frombuffer(r["n2"], "<i8").astype(float)
                    v = np.frombuffer(r["vectors"], "<i4").reshape(len(n2), r["dim"])
                    low, high, kth = (np.frombuffer(r[k], "<i8").reshape(len(n2), r["slots"]) for k in ("low", "high", "kth"))
                    for at in range(0, len(n2), PRODUCT):
                        cut = slice(at, at + PRODUCT)
                        chosen |= _next_cells(v[cut], n2[cut], low[cut], high[cut], kth[cut], centres, most, dim, cells // RINGS, lo, hi, sizes, seen, budget)
                    yield pd.DataFrame({"block": np.full(chosen.sum(), r["block"], np.int32), "cell": cells[chosen].astype(np.int32)})

        return staged(_map(state, rows, "block int, cell int"), "wanted")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """HITS and rank: for every query and slot the k best rows of its label (not itself), or of others, whose score lies
        in the slot's bounds; ties by vec_id."""
        state = queries.withColumns({"seen": F.lit(b""), "kth": F.expr(f"unhex(repeat('{np.int64(_NONE).tobytes().hex()}', cast(length(low) / 8 as int)))")})
        salted = self.chunks.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int"))
        parts = max(1, self.chunks.count() // TASK_CHUNKS)
        found, turn = None, 0
        while True:
            wanted = self._wanted(state, turn)
            asked = wanted.count()
            if not asked:
                break
            self.asked += asked
            part = F.pmod(F.xxhash64("chunk", F.lit(1)), F.lit(parts)).cast("int").alias("part")
            met = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["cell", "salt"]).select("block", part, *[c.split()[0] for c in CHUNKS.split(", ")])
            asking = wanted.join(self.chunks.select("cell", "chunk"), "cell").select("block", part).distinct().join(state, "block")
            asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])  # columns of its own: both sides come from `wanted`
            hits = asking.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInPandas(_scanner(k, same), HITS)
            hits = hits if found is None else found.select(*HITS.replace(" int", "").replace(" long", "").split(", ")).unionByName(hits)
            best = F.row_number().over(W.partitionBy("block", "q", "slot").orderBy(F.col("score").desc(), "vec_id"))
            found = staged(hits.withColumn("rank", best).where(F.col("rank") <= k), "hits")
            state = staged(state.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(_seen, STATE), "state")
            state = staged(state.groupBy("block").cogroup(found.where(F.col("rank") == k).groupBy("block")).applyInPandas(_bounded, STATE), "state")
            turn += 1
        return self.chunks.sparkSession.createDataFrame([], f"{HITS}, rank int") if found is None else found


def _next_cells(v, n2, low, high, kth, centres, most, dim, pivot, lo, hi, sizes, seen, budget) -> np.ndarray:
    """Which unseen cells some of these queries need. One that lacks hits asks for the nearest ones, `budget` rows of them;
    one that has its k hits asks for all that may hold a better one."""
    q = _augmented(v, np.full(len(v), most), most, dim)  # a query's last component is 0
    apart = _apart(q, centres)[:, pivot]
    least, greatest = np.maximum(0, np.maximum(lo - apart, apart - hi)), apart + hi
    radius = lambda score: np.sqrt(np.maximum(n2[:, None] + most - 2.0 * score, -1.0).clip(0))
    inner = np.where(high == _ALL, 0, radius(np.where(high == _ALL, 0, high).astype(float)))
    worst = np.maximum(low, kth)
    outer = np.where(worst == _NONE, np.inf, radius(np.where(worst == _NONE, 0, worst).astype(float)))
    slack = SLACK * (1 + np.sqrt(float(most)))
    need, lacking = np.zeros(least.shape, bool), np.zeros(len(v), bool)
    for s in range(low.shape[1]):
        open_ = (low[:, s] <= high[:, s])[:, None]
        need |= open_ & (least <= outer[:, s, None] + slack) & (greatest >= inner[:, s, None] - slack)
        lacking |= open_[:, 0] & (kth[:, s] == _NONE)
    need &= ~seen
    order = np.argsort(np.where(need, least, np.inf), axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(np.where(need, sizes, 0), order, 1), axis=1)
    before = np.concatenate([np.zeros((len(v), 1)), before[:, :-1]], 1)
    near = np.zeros_like(need)
    np.put_along_axis(near, order, before < budget, 1)
    return (need & (near | ~lacking[:, None])).any(0)


def _scanner(k: int, same: bool):
    """The best rows of a part's chunks for the queries of a block."""

    def scan(asking: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        names = ["block", "q", "slot", "vec_id", "score"]
        if not len(asking) or not len(chunks):
            return pd.DataFrame({c: [] for c in names})
        r = asking.iloc[0]
        ids, labels = (np.frombuffer(r[c], "<i8") for c in ("ids", "labels"))
        v = np.frombuffer(r["vectors"], "<i4").reshape(len(ids), r["dim"]).astype(np.int64)
        low, high, kth = (np.frombuffer(r[c], "<i8").reshape(len(ids), r["slots"]) for c in ("low", "high", "kth"))
        least, found = np.maximum(low, kth), [[] for _ in range(r["slots"])]
        for c in chunks.to_dict("records"):
            own, own_labels = (np.frombuffer(c[x], "<i8") for x in ("ids", "labels"))
            x = np.frombuffer(c["vectors"], "<i4").reshape(c["rows"], c["dim"]).astype(np.int64)
            for at in range(0, len(ids), PRODUCT):
                cut = slice(at, at + PRODUCT)
                scores = _products(v[cut], x)
                alike = labels[cut, None] == own_labels
                allowed = alike & (ids[cut, None] != own) if same else ~alike
                for s in range(r["slots"]):
                    good = allowed & (scores >= least[cut, s, None]) & (scores <= high[cut, s, None])
                    if len(own) > k:
                        good &= scores >= np.partition(np.where(good, scores, _NONE), len(own) - k, axis=1)[:, len(own) - k, None]
                    q, row = np.nonzero(good)
                    kept = first_of_each(q, -scores[q, row], own[row], k)
                    found[s].append((q[kept] + at, scores[q, row][kept], own[row][kept]))
        out = []
        for s, parts in enumerate(found):
            q, score, ident = (np.concatenate([p[i] for p in parts]) for i in range(3))
            kept = first_of_each(q, -score, ident, k)
            out.append(pd.DataFrame({"block": r["block"], "q": q[kept].astype(np.int32), "slot": s, "vec_id": ident[kept], "score": score[kept]}, columns=names))
        return pd.concat(out)

    return scan


def _seen(state: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    return state.assign(seen=[raw + wanted["cell"].to_numpy("<i4").tobytes() for raw in state["seen"]])


def _bounded(state: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
    """last: the k-th hits of the block's queries and slots."""
    r = state.iloc[0]
    kth = np.frombuffer(r["kth"], "<i8").copy()
    kth[last["q"].to_numpy(np.int64) * r["slots"] + last["slot"].to_numpy(np.int64)] = last["score"].to_numpy(np.int64)
    return state.assign(kth=[kth.tobytes()])


def _windows(queries: pd.DataFrame, positives: pd.DataFrame) -> pd.DataFrame:
    """A slot for each positive: the scores that its negatives may have; none where there is no positive."""
    n = len(queries["ids"].iloc[0]) // 8
    low, high = np.full((n, POSITIVES), _ALL, "<i8"), np.full((n, POSITIVES), _NONE, "<i8")
    whole, rest = np.divmod(positives["score"].to_numpy(np.int64), 100)
    at = positives["q"].to_numpy(np.int64), positives["rank"].to_numpy(np.int64) - 1
    low[at], high[at] = LOW * whole - (-LOW * rest // 100), HIGH * whole + HIGH * rest // 100
    return queries.assign(low=[low.tobytes()], high=[high.tobytes()], slots=np.int32(POSITIVES))


def mined(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = Index(embeddings)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.rows:
        return embeddings.sparkSession.createDataFrame([], names)
    queries = index.blocks(index.keyed.where(F.col("vec_id") % ANCHOR_EVERY == 0))
    positives = index.search(queries, POSITIVES, True)
    windows = staged(queries.groupBy("block").cogroup(positives.groupBy("block")).applyInPandas(_windows, QUERIES), "windows")
    negatives = index.search(windows, NEGATIVES, False)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, ids in zip(b["block"], b["ids"], strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"block": np.full(len(own), block, np.int32), "q": np.arange(len(own), dtype=np.int32), "anchor_id": own})

    named = _map(queries.select("block", "ids"), anchors, "block int, q int, anchor_id long")
    first = positives.select("block", "q", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    then = negatives.select("block", "q", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return then.join(first, ["block", "q", "slot"]).join(named, ["block", "q"]).select(*[c.split()[0] for c in names.split(", ")])


#: Whole, by brute force.
ORACLE = f"""
WITH x AS (SELECT vec_id, CASE WHEN vec_id % {FLIP_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM x WHERE vec_id % {ANCHOR_EVERY} = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM a, x WHERE a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""
