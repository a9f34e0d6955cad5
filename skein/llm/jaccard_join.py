"""Operator 5: n-gram Jaccard join by vertical partitioning, with classes of linked documents.

The global order of the n-grams is cut into fragments. Every document's set is cut along them, each fragment counts
for itself, and the partial counts are summed:
1. per document, how many of its n-grams occur in another set: a document below the threshold links with nothing;
2. for the others, the document frequencies that give the global order, rare first;
3. per pair, the overlaps of the fragments' cuts, of candidates that share an n-gram within the prefixes.

Equal sets are one class before that. Pairs are not expanded within groups: each document is first held against a
hub of a list it stands in, classes grow from verified links, and only lists that still hold several classes are
looked at again, with other hubs; at last every remaining pair of different classes that passes the prefix, size and
position filters is verified, so no link between different classes is lost.

Defined results: a null or empty text has an empty set and its own id as class; rows with a null doc_id take the class
of an equal set that has an id, else null; repeated rows give a row each; several texts under one id are one document, with
the links of all of them; an empty table gives an empty one; texts of any length are taken whole; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, doc_texts, small_batches, staged
from skein.llm.exchange import blocks, by_fragment, fragments, in_batches, runs, shingles, word_hashes

WIDTH, PERCENT = 4, 85
HUB_ROUNDS = 4
#: Parts in which a list's documents meet what is known of the list, so that a list of very many is no single task.
SALTS = 8
#: Cuts of the hash range in which a pair's overlap is counted.
PAIR_CUTS = 4

_L, _B, _I = T.LongType(), T.BinaryType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def set_sizes(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, n, id1, id2 (identity of the set), shared: at least as many as its n-grams that another row has, too.

    A fragment gets the low 32 bits of the n-grams and which documents of a block they are of, and answers for these
    documents only. Equal low bits and equal sets make `shared` too large, never too small: it only says who goes on.
    """
    count = fragments(texts.sparkSession)
    cut = _struct(frag=_I, block=_L, present=_B, lens=_B, grams=_B)
    head = _struct(docs=_B, nulls=_B, sizes=_B, id1=_B, id2=_B)

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        for block, ids, sets in blocks(batches, lambda t: shingles(word_hashes(t), width)):
            sizes = np.array([len(s) for s in sets], "<u4")
            known = np.array([_identity(s) for s in sets], "<i8").reshape(-1, 2)
            yield {
                "frag": block % count, "block": block, "docs": np.array([i or 0 for i in ids], "<i8").tobytes(), "nulls": np.array([i is None for i in ids]).tobytes(),
                "sizes": sizes.tobytes(), "id1": known[:, 0].tobytes(), "id2": known[:, 1].tobytes(),
            }
            grams = np.concatenate([np.empty(0, np.uint64), *sets])
            del sets
            order, ends = by_fragment(grams, count)
            low = grams.astype("<u4")[order]
            del grams
            who = np.repeat(np.arange(len(ids), dtype="<u4"), sizes)[order]
            for f in np.flatnonzero(np.diff(ends)).tolist():
                present, lens = runs(who[ends[f] : ends[f + 1]])
                yield {"frag": f, "block": block, "present": present.tobytes(), "lens": lens.astype("<u4").tobytes(), "grams": low[ends[f] : ends[f + 1]].tobytes()}

    sent = T.StructType([*cut, *head])
    split = lambda batches: in_batches(pieces(batches), sent.names)
    answer = T.StructType([T.StructField("block", _L), T.StructField("present", _B), T.StructField("counts", _B), *head])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf["grams"].notna()
        mine, own = pdf[has], pdf[~has]
        lens = [np.frombuffer(x, "<u4") for x in mine["lens"]]
        grams = np.concatenate([np.empty(0, "<u4"), *[np.frombuffer(x, "<u4") for x in mine["grams"]]])
        order = np.argsort(grams, kind="stable")
        _, lengths = runs(grams[order])
        many = np.zeros(len(grams), bool)
        many[order] = np.repeat(lengths > 1, lengths)
        who = np.repeat(np.arange(sum(map(len, lens))), np.concatenate([np.empty(0, np.int64), *lens]).astype(np.int64))
        total = np.bincount(who[many], minlength=sum(map(len, lens))).astype("<u4")
        cuts = np.cumsum([len(x) for x in lens])[:-1]
        told = pd.DataFrame({"block": mine["block"], "present": mine["present"], "counts": [x.tobytes() for x in np.split(total, cuts)][: len(mine)]})
        return pd.concat([told, own]).reindex(columns=answer.names)

    final = _struct(doc_id=_L, n=_L, id1=_L, id2=_L, shared=_L)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["docs"].notna()].iloc[0]
        ids = pd.array(np.frombuffer(own["docs"], "<i8"), dtype="Int64")
        ids[np.frombuffer(own["nulls"], bool)] = pd.NA
        total = np.zeros(len(ids), np.int64)
        for present, counts in zip(pdf["present"], pdf["counts"], strict=True):
            if present is not None:
                total[np.frombuffer(present, "<u4")] += np.frombuffer(counts, "<u4")
        return pd.DataFrame({"doc_id": ids, "n": np.frombuffer(own["sizes"], "<u4").astype(np.int64), "id1": np.frombuffer(own["id1"], "<i8"), "id2": np.frombuffer(own["id2"], "<i8"), "shared": total})

    replies = arrow_map(texts, split, sent).groupBy("frag").applyInPandas(shared, answer)
    return replies.groupBy("block").applyInPandas(merge, final)


def _least(n: Column, percent: int) -> Column:
    """Overlap that any partner of a set of n n-grams needs."""
    return F.ceil(n * percent / 100.0 - 1e-9)


def rep_sets(texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """doc_id (the set's number), n, grams (packed, sorted) of the sets that stand for others. reps: doc_id (of a row that
    holds the set), sid, id1, id2."""
    joined = texts.join(reps.select("doc_id", "sid", "id1", "id2"), "doc_id")
    schema = _struct(doc_id=_L, n=_I, grams=_B)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "n": [], "grams": []}
            for i, t, a, c in zip(b["sid"], b["text"], b["id1"], b["id2"], strict=True):
                s = shingles(word_hashes(t), width)
                if _identity(s) == (a, c):  # an id may be repeated with another text
                    for k, v in zip(out, (i, len(s), s.tobytes()), strict=True):
                        out[k].append(v)
            yield out

    return arrow_map(joined.select("sid", "text", "id1", "id2"), rows, schema).dropDuplicates(["doc_id"])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """gram, doc_id, n, pos, own: n-grams of other sets, too, within the prefix of each document in the global order;
    own is how many of the document's n-grams no other set has."""
    count = fragments(sets.sparkSession)
    cut = _struct(frag=_I, block=_L, docs=_B, lens=_B, grams=_B)

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        found = ({"doc_id": b["doc_id"], "text": b["grams"]} for b in batches)
        for block, ids, sets_ in blocks(found, lambda raw: np.frombuffer(raw, "<u8")):
            grams, docs = np.concatenate(sets_), np.array(ids, "<i8")
            order, ends = by_fragment(grams, count)
            grams, who = grams[order], np.repeat(np.arange(len(ids), dtype="<u4"), [len(s) for s in sets_])[order]
            for f in np.flatnonzero(np.diff(ends)).tolist():
                present, lens = runs(who[ends[f] : ends[f + 1]])
                yield {"frag": f, "block": block, "docs": docs[present].tobytes(), "lens": lens.astype("<u4").tobytes(), "grams": grams[ends[f] : ends[f + 1]].tobytes()}

    split = lambda batches: in_batches(pieces(batches), cut.names)
    answer = _struct(block=_L, docs=_B, lens=_B, grams=_B, freq=_B)

    def frequency(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8") for x in pdf["grams"]]
        _, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        freq = np.split(counts[back].astype("<u4"), np.cumsum([len(p) for p in parts])[:-1])
        return pdf.drop(columns="frag").assign(freq=[f.tobytes() for f in freq])

    final = _struct(gram=_L, doc_id=_L, n=_I, pos=_I, own=_I)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(x, "<u4").astype(np.int64)) for d, x in zip(pdf["docs"], pdf["lens"], strict=True)])
        grams = np.concatenate([np.frombuffer(x, "<u8") for x in pdf["grams"]])
        freq = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["freq"]])
        by = np.lexsort((grams, freq, docs))
        docs, grams, freq = docs[by], grams[by], freq[by]
        starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        n = np.diff(np.concatenate([starts, [len(docs)]]))
        pos = np.arange(len(docs)) - np.repeat(starts, n) + 1
        own = np.repeat(np.add.reduceat((freq == 1).astype(np.int32), starts), n)
        n = np.repeat(n, n)
        keep = (pos <= n - -(-n * percent // 100) + 1) & (freq > 1)
        return pd.DataFrame({"gram": grams[keep].astype(np.int64), "doc_id": docs[keep], "n": n[keep].astype(np.int32), "pos": pos[keep].astype(np.int32), "own": own[keep]})

    return arrow_map(sets.select("doc_id", "grams"), split, cut).groupBy("frag").applyInPandas(frequency, answer).groupBy("block").applyInPandas(order, final)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets link: the overlap is counted in cuts of the hash range and summed."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb")), "b")
    both = both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    edges = [np.uint64(i * 2**64 // PAIR_CUTS) for i in range(1, PAIR_CUTS)]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for a, c, ga, gb in zip(b["a"], b["b"], b["ga"], b["gb"], strict=True):
                x, y = np.frombuffer(ga, "<u8"), np.frombuffer(gb, "<u8")
                cx, cy = [0, *np.searchsorted(x, edges), len(x)], [0, *np.searchsorted(y, edges), len(y)]
                common = sum(_overlap(x[cx[k] : cx[k + 1]], y[cy[k] : cy[k + 1]]) for k in range(PAIR_CUTS))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(c)
            yield out

    return arrow_map(both.select("a", "b", "ga", "gb"), rows, _struct(a=_L, b=_L))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def components(edges: DataFrame) -> DataFrame:
    """id, label: for the nodes of the edges (a, b) the smallest id that can be reached. Minimum labels and pointer jumps."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = step.join(labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new", "left")
        step = staged(jump.select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        if step.where("label <> new").isEmpty():
            return labels
        labels = step.select("id", F.col("new").alias("label"))


def _relabel(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps: doc_id, comp. links: pairs of documents; their classes become one."""
    of = lambda c: comps.select(F.col("doc_id").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    new = components(edges)
    return staged(comps.join(new.withColumnRenamed("id", "comp"), "comp", "left").select("doc_id", F.coalesce("label", "comp").alias("comp")), "comps")


def _by_list(entries: DataFrame, known: DataFrame, who: str = "doc_id") -> DataFrame:
    """entries (gram, who, ...) with what is known of their list: a row a list, repeated for each part of it."""
    parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return entries.withColumn("salt", F.pmod(F.xxhash64(who), F.lit(SALTS)).cast("int")).join(parts, ["gram", "salt"]).drop("salt")


def _mixed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries, with their class, of the lists that hold several classes."""
    own = lists.join(comps, "doc_id")
    several = own.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    return _by_list(own, several)


def link_classes(sets: DataFrame, percent: int, lists_of: Callable[[DataFrame, int], DataFrame] = prefixes, verified: Callable[[DataFrame, DataFrame, int], DataFrame] = similar) -> DataFrame:
    """doc_id, comp of every set that is linked or not, by hubs first and then by all pairs that remain.

    lists_of: sets to gram, doc_id, n, pos, own, such that linked sets share a gram; verified: pairs (a, b) to those that link."""
    lists = staged(lists_of(sets, percent), "prefixes")
    comps = staged(sets.select("doc_id", F.col("doc_id").alias("comp")), "comps")
    tried = None
    for turn in range(HUB_ROUNDS):
        mixed = staged(_mixed(lists, comps), "mixed")
        if mixed.isEmpty():
            return comps
        # in even rounds the hub is the most central text of the list, that with the fewest n-grams of its own
        first = F.struct(F.col("own") if turn % 2 == 0 else F.lit(0), F.xxhash64("doc_id", F.lit(turn)))
        hubs = mixed.groupBy("gram").agg(F.min_by(F.struct(F.col("doc_id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb")), first).alias("h")).select("gram", "h.*")
        met = _by_list(mixed, hubs).where("comp <> cb").where(F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent)
        met = met.groupBy("doc_id", "b").agg(F.count("*").alias("k"))
        if tried is not None:
            met = met.join(tried.select(F.col("a").alias("doc_id"), "b"), ["doc_id", "b"], "left_anti")
        pairs = staged(met.groupBy("doc_id").agg(F.max_by("b", F.struct("k", F.xxhash64("b"))).alias("b")).withColumnRenamed("doc_id", "a"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        comps = _relabel(comps, staged(verified(pairs, sets, percent), "links"))
    mixed = staged(_mixed(lists, comps), "mixed")
    need = lambda a, b: F.ceil((F.col(a) + F.col(b)) * percent / (100.0 + percent) - 1e-9)
    index = mixed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100.0 + percent) - 1e-9) + 1)
    small = index.select("gram", F.col("doc_id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    large = mixed.select("gram", F.col("doc_id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    rest = _by_list(large, small, "b").where("ca <> cb AND na <= nb").where(F.col("na") * 100 >= F.col("nb") * percent)
    rest = rest.where(1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need("na", "nb")).select("a", "b").distinct()
    rest = rest.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    return _relabel(comps, staged(verified(rest, sets, percent), "links"))


def _one_document(comps: DataFrame, rows: DataFrame) -> DataFrame:
    """Classes of sets that stand under one doc_id are one class. rows: doc_id, sid."""
    first = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z")
    if first.isEmpty():
        return comps
    links = first.join(rows, "doc_id").where("a <> sid").select("a", F.col("sid").alias("b")).distinct()
    return _relabel(comps, staged(links, "links"))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. Sets are numbered, so that an id with several texts keeps all their
    links; such texts are one document."""
    small_batches(docs.sparkSession)
    texts = doc_texts(docs)
    sizes = staged(set_sizes(texts, width), "sizes")
    own = sizes.where("n > 0").groupBy("id1", "id2", "n").agg(F.min("doc_id").alias("doc_id"), F.max("shared").alias("shared"))
    own = staged(own.withColumn("sid", F.monotonically_increasing_id()), "classes")
    reps = own.where(F.col("doc_id").isNotNull() & (F.col("shared") >= _least(F.col("n"), percent)))
    sets = staged(rep_sets(texts, reps, width), "sets")
    linked = link_classes(sets, percent)
    comps = own.select(F.col("sid").alias("doc_id")).join(linked, "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    rows = sizes.where("n > 0").join(own.select("id1", "id2", "sid"), ["id1", "id2"]).select("doc_id", "sid")
    comps = _one_document(comps, rows)
    known = own.select("id1", "id2", "doc_id", F.col("sid")).join(comps.withColumnRenamed("doc_id", "sid"), "sid")
    least = known.groupBy("comp").agg(F.min("doc_id").alias("c"))
    ids = staged(known.join(least, "comp").select("id1", "id2", "c"), "components")
    return sizes.join(ids, ["id1", "id2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))


#: Whole: sets, links by their definition over all pairs that share a shingle, and smallest reachable ids.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, len(w) - {WIDTH - 2})]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT edge.b, walk.c FROM walk JOIN edge ON edge.a = walk.doc_id WHERE walk.c < edge.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM walk GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
