"""Operator 8: benchmark decontamination by SimHash windows and a block index.

Items and texts are words of letters and digits; a window's fingerprint is the 64-bit SimHash of its words, kept as
running sums of byte counters. Two kinds of windows are fingerprinted, and both are looked up alike: a text's window meets
an item's if the fingerprints differ in at most RADIUS bits. RADIUS + 1 blocks of 16 bits are indexed, of which two such
fingerprints have one in common, so the block index loses none; the bits of those that meet in a block are counted.

* Long windows have the item's size, rounded down on a ladder (`long_size`), and stand at both ends of the item, of items
  above LONGEST words one after another. A text gives one at every STRIDE words; items give STRIDE neighbours, so
  one of them meets a copy wherever it begins. A changed word moves a few bits only.
* Short windows of WIDTH words are taken at every word. A fingerprint of few words moves much with each of them, but a
  window left intact has distance 0: an item gives those of its rarest shingles of together more than what a passage of
  the wanted similarity may lack, and every such passage has at least one of them, whatever was cut, changed, put in or
  moved, and however short the text. So no passage that verification accepts is lost.

Every (text, item) that meets is then verified exactly: of all windows of the item's size, the one with the largest share
of the item's weighted five-word shingles.

Weights come from all items, however they are dealt to rounds.

Defined results: a null or empty text, an item without words, an empty table on either side: no rows. Texts of any length are
searched whole, in chunks of words. Repeated rows
give a row each; an item that stands in a text several times gives its first best place; a null id stays null; other
columns are not looked at. An item of fewer than WIDTH words is one shingle of its own length; one of fewer than WIDTH +
STRIDE - 1 has short windows only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, doc_texts, small_batches, staged
from skein.llm.exchange import hashes

WIDTH, SIMILARITY = 5, 0.8
#: Bits in which fingerprints that meet may differ; two such have one of RADIUS + 1 blocks in common.
RADIUS, BLOCKS = 3, 4
#: Words between the long windows of a text, most words of a window (byte counters hold 255), pairs counted at once.
STRIDE, LONGEST, PAIRS = 4, 250, 1 << 20
#: Windows that are fingerprinted together (64 bytes each).
WINDOWS = 65536
#: Items up to which they are sent to every task; more are taken in rounds of so many.
ROUND_ITEMS = 2_000
#: Words of texts that are handled together.
CHUNK_WORDS = 200_000
WORD = re.compile(r"[^\W_]+")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_SPREAD = np.ascontiguousarray(_BITS).view(np.uint64)[:, 0]  # a byte's bits as eight byte counters


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def running(h: np.ndarray) -> np.ndarray:
    """Sums of byte counters before each word: (n + 1, 8) uint64; differences are exact for windows up to 255 words."""
    lanes = _SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)]
    out = np.zeros((len(h) + 1, 8), np.uint64)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray | slice, size: int) -> np.ndarray:
    """SimHash of the windows [start, start + size): a bit is set if more than half of the words have it."""
    after = slice(starts.start + size, starts.stop + size, starts.step) if isinstance(starts, slice) else starts + size
    counts = (sums[after] - sums[starts]).view(np.uint8)
    return np.packbits(counts > size // 2, bitorder="little").view("<u8")


def shingle_keys(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    if len(h) < width:
        width = max(1, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + k + 1]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    return out


def long_size(words: int) -> int:
    """Words of an item's long windows: the last step of a ladder that leaves room for STRIDE of them; 0 if none does."""
    size = 0
    while (more := max(WIDTH, size + 1, size * 5 // 4)) <= min(LONGEST, words - STRIDE + 1):
        size = more
    return size


def long_starts(words: int, size: int) -> np.ndarray:
    """Where an item's long windows begin: STRIDE neighbours at its front, one after another through it, and at its end."""
    first = np.array([*range(0, words - size + 1, size), max(0, words - size - STRIDE + 1)])
    starts = np.unique(first[:, None] + np.arange(STRIDE))
    return starts[starts <= words - size]


class Index:
    """Items' fingerprints by window size with block tables, long windows (classes) and short ones (of WIDTH words, or an
    item's fewer), and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, known: tuple[int, dict[int, int]] | None = None):
        """known: how many items there are in all, and how many of them each shingle stands in; else counted over `items`."""
        self.ids, self.hashes, self.least = [], [], similarity
        for i, text in items:
            h = hashes(words_of(text or ""))
            if len(h):
                self.ids.append(i)
                self.hashes.append(h)
        keys = [shingle_keys(h) for h in self.hashes]
        total, df = known or (len(keys), Counter(k for own in keys for k in set(own.tolist())))
        self.counts = [Counter(own.tolist()) for own in keys]
        self.weights = [Counter({k: n * math.log(1 + total / df[k]) for k, n in own.items()}) for own in self.counts]
        self.offsets: list[dict[int, list[int]]] = []
        long: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for j, (h, own) in enumerate(zip(self.hashes, keys, strict=True)):
            at: dict[int, list[int]] = {}
            for o, k in enumerate(own.tolist()):
                at.setdefault(k, []).append(o)
            self.offsets.append(at)
            # the rarest shingles until a passage without any of them cannot reach the similarity
            weights, lacking, first = self.weights[j], 0.0, []
            most = (1 - similarity) * sum(weights.values()) * (1 + 1e-9)
            for k in sorted(weights, key=lambda k: (df[k], k)):
                if lacking > most:
                    break
                lacking += weights[k]
                first.append(at[k][0])
            sums, size = running(h), min(WIDTH, len(h))
            short.setdefault(size, []).extend((f, j) for f in fingerprints(sums, np.array(first), size).tolist())
            if size := long_size(len(h)):
                long.setdefault(size, []).extend((f, j) for f in fingerprints(sums, long_starts(len(h), size), size).tolist())
        self.classes, self.short = ({size: self._blocks(found) for size, found in by.items()} for by in (long, short))

    @staticmethod
    def _blocks(found: list[tuple[int, int]]) -> tuple:
        """Distinct fingerprints, their items and where each one's begin among these; of every block which values
        there are, the fingerprints' values in order, and whose they are."""
        found = sorted(set(found))
        prints, begin = np.unique(np.array([x[0] for x in found], np.uint64), return_index=True)
        parts = prints.view("<u2").reshape(-1, BLOCKS)
        tables = np.zeros((BLOCKS, 65536), bool)
        for b in range(BLOCKS):
            tables[b, parts[:, b]] = True
        order = [np.argsort(parts[:, b], kind="stable") for b in range(BLOCKS)]
        return prints, np.array([x[1] for x in found]), np.append(begin, len(found)), tables, [parts[o, b] for b, o in enumerate(order)], order

    @staticmethod
    def near(known: tuple, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in found, place in the known fingerprints) of the pairs at most RADIUS bits apart; some come repeatedly."""
        prints, _, _, tables, values, order = known
        parts = found.view("<u2").reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            hit = np.flatnonzero(tables[b][parts[:, b]])
            if not len(hit):
                continue
            lo, hi = (np.searchsorted(values[b], parts[hit, b], side) for side in ("left", "right"))
            ends = np.cumsum(hi - lo)
            cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS))
            for own in np.split(np.arange(len(hit)), cuts) if len(cuts) else [slice(None)]:
                n = hi[own] - lo[own]
                which = order[b][np.arange(n.sum()) + np.repeat(lo[own] - np.cumsum(n) + n, n)]
                at = np.repeat(hit[own], n)
                good = np.flatnonzero(np.bitwise_count(found[at] ^ prints[which]) <= RADIUS)
                if len(good):
                    yield at[good], which[good]

    def met(self, classes: dict[int, tuple], step: int, sums: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) with windows that meet, of a text's windows at every `step` words of the running sums."""
        out: set[tuple[int, int]] = set()
        for size, known in classes.items():
            _, item, begin, *_ = known
            windows = len(sums) - size
            for at in range(0, windows, WINDOWS * step):
                found = fingerprints(sums, slice(at, min(at + WINDOWS * step, windows), step), size)
                for place, which in self.near(known, found):
                    start = at + place * step
                    text = np.searchsorted(bounds, start, "right") - 1
                    inside = start + size <= bounds[text + 1]  # no window over the border of two texts
                    for t, x in set(zip(text[inside].tolist(), which[inside].tolist(), strict=True)):
                        out.update((t, j) for j in item[begin[x] : begin[x + 1]].tolist())
        return out

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that have windows that meet. bounds: where each text begins in the words h, and the end."""
        sums = running(h)
        return self.met(self.classes, STRIDE, sums, bounds) | self.met(self.short, 1, sums, bounds)

    def best_place(self, item: int, h: np.ndarray, places: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[float, int] | None:
        """(similarity, start) of the best window of the item's size in a text, if it reaches the similarity.

        places: the text's shingle keys in order, and where each stands. A window loses nothing when its start moves on
        to the next shingle of the item, so windows that begin with one are all that need be seen.
        """
        weights, counts, n = self.weights[item], self.counts[item], len(self.hashes[item])
        own = np.fromiter(weights, np.uint64, len(weights))
        lo, hi = np.searchsorted(places[0], own, "left"), np.searchsorted(places[0], own, "right")
        total = sum(weights.values())
        if sum(w * min(1.0, m / counts[k]) for (k, w), m in zip(weights.items(), (hi - lo).tolist(), strict=True)) < similarity * total * (1 - 1e-9):
            return None
        seen = sorted((p, k) for k, a, z in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True) for p in places[1][a:z].tolist())
        last, held, got, right, top = n - min(WIDTH, n), Counter(), 0.0, 0, (-1.0, 0, 0)
        for left, (p, k) in enumerate(seen):
            while right < len(seen) and seen[right][0] <= p + last:
                x = seen[right][1]
                held[x] += 1
                got += weights[x] / counts[x] if held[x] <= counts[x] else 0.0
                right += 1
            if got > top[0] + 1e-9 * total:
                top = (got, left, seen[right - 1][0])
            got -= weights[k] / counts[k] if held[k] <= counts[k] else 0.0
            held[k] -= 1
        _, left, end = top
        p, k = seen[left]
        # where the item's own first word would stand, if that window holds the same shingles
        start = min([a for o in self.offsets[item][k] if (a := max(0, p - o)) >= end - last], default=p)
        s = self.similarity(item, h[start : start + n])
        return (s, start) if s >= similarity else None

    def similarity(self, item: int, window: np.ndarray) -> float:
        weights = self.weights[item]
        if len(window) < WIDTH and len(window) != len(self.hashes[item]):
            return 0.0
        found = Counter(shingle_keys(window).tolist())
        total = sum(weights.values())
        got = sum(w * min(1.0, found[k] / n) for k, w in weights.items() if (n := self.counts[item][k]) and k in found)
        return got / total

    def leaks(self, texts: list[str], similarity: float) -> list[dict[int, tuple[float, int]]]:
        """For each text: number of an item found in it -> (similarity, start word), at its best place."""
        if similarity < self.least:
            raise ValueError(f"indexed for a similarity of at least {self.least}")
        found, out, lo = [hashes(words_of(t)) for t in texts], [], 0
        while lo < len(found):
            hi, n = lo, 0
            while hi < len(found) and (hi == lo or n + len(found[hi]) <= CHUNK_WORDS):
                n += len(found[hi])
                hi += 1
            h = np.concatenate(found[lo:hi])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found[lo:hi]])])
            best: list[dict[int, tuple[float, int]]] = [{} for _ in range(hi - lo)]
            places: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for text, item in sorted(self.candidates(h, bounds)):
                own, width = h[bounds[text] : bounds[text + 1]], min(WIDTH, len(self.hashes[item]))
                if (text, width) not in places:
                    keys = shingle_keys(own, width)
                    order = np.argsort(keys, kind="stable")
                    places[text, width] = (keys[order], order)
                place = self.best_place(item, own, places[text, width], similarity)
                if place:
                    best[text][item] = place
            out += best
            lo = hi
        return out


Round = tuple[list[tuple[int, str]], tuple[int, dict[int, int]]]


def _keyed(items: DataFrame) -> DataFrame:
    """item_id, text, and key of each distinct shingle of the items; an item without words has none."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", T.LongType())])

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            own = [np.unique(shingle_keys(h)) if len(h := hashes(words_of(t))) else np.empty(0, np.uint64) for t in b["text"]]
            yield {"item": np.repeat(np.array(b["item"], np.int64), [len(k) for k in own]), "key": np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)}

    return arrow_map(items.select("item", "text"), rows, schema)


def _rounds(benchmark: DataFrame) -> list[Round]:
    """The items, in rounds of at most ROUND_ITEMS or so: benchmarks are short lists, a longer one takes several rounds.
    In how many items a shingle stands is counted over all of them, so a weight does not depend on the rounds."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where("text IS NOT NULL")
    items = items.withColumn("item", F.xxhash64("item_id", "text"))
    rounds = max(1, -(-items.count() // ROUND_ITEMS))
    if rounds == 1:
        own = _in_order(items.select("item_id", "text").collect())
        keys = [np.unique(shingle_keys(h)) for _, t in own if len(h := hashes(words_of(t)))]
        return [(own, (len(keys), Counter(k for x in keys for k in x.tolist())))]
    # equal rows count as often as they stand
    keyed = staged(items.groupBy("item").count().join(_keyed(items.dropDuplicates(["item"])), "item"), "shingles")
    total = keyed.select("item", "count").distinct().agg(F.sum("count")).first()[0] or 0
    counted = staged(keyed.groupBy("key").agg(F.sum("count").alias("df")), "frequencies")
    out = []
    for r in range(rounds):
        mine = F.pmod("item", F.lit(rounds)) == r
        of = keyed.where(mine).select("key").distinct().join(counted, "key")
        known = {x["key"] & (1 << 64) - 1: x["df"] for x in of.collect()}  # the shingles of a round's items
        out.append((_in_order(items.where(mine).select("item_id", "text").collect()), (total, known)))
    return out


def _in_order(items: list) -> list[tuple[int, str]]:
    return sorted([(x["item_id"], x["text"]) for x in items], key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, similarity: every item found in a text, at its best place."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("similarity", T.DoubleType())])
    texts, out = doc_texts(docs), None
    for mine in _rounds(benchmark):

        def rows(batches: Iterator[dict], mine: Round = mine) -> Iterator[dict]:
            index = Index(mine[0], similarity, mine[1])
            for b in batches:
                made: dict[str, list] = {f.name: [] for f in schema}
                for doc, best in zip(b["doc_id"], index.leaks(b["text"], similarity), strict=True):
                    for item, (s, at) in sorted(best.items()):
                        for k, v in zip(made, (doc, index.ids[item], at, round(s, 6)), strict=True):
                            made[k].append(v)
                yield made

        one = arrow_map(texts, rows, schema)
        out = one if out is None else out.unionByName(one)
    return out


digest = leaks


def cleaned(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, in all their columns, without those in which an item is found. No join: each row is judged where it is."""
    small_batches(docs.sparkSession)
    for mine in _rounds(benchmark):

        def rows(batches: Iterator[dict], mine: Round = mine) -> Iterator[dict]:
            index = Index(mine[0], similarity, mine[1])
            for b in batches:
                keep = [not best for best in index.leaks([t or "" for t in b["text"]], similarity)]
                yield {k: [x for x, good in zip(v, keep, strict=True) if good] for k, v in b.items()}

        docs = arrow_map(docs, rows, docs.schema)
    return docs
