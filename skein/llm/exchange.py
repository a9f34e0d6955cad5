"""Blocks of documents and their hashed features, dealt by fragments of the hash range and answered.

A block is the documents of up to BLOCK_FEATURES features of one input partition. What a fragment gets of a block is
one row with packed arrays, so millions of features cost a few thousand rows; fragments are even, since a hash deals
them out, whatever the sources, groups or frequent features are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import SparkSession

from skein.llm.common import ascii_lower, mix64, plain_words, worker_cache

BLOCK_FEATURES = 1_000_000
#: Rows of a batch that goes to the JVM: packed arrays of a block are sent in several.
PACKED_ROWS = 64
#: Distinct words a worker keeps the hashes of; beyond, it begins anew.
CACHE_WORDS = 300_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def hashes(words: list[str]) -> np.ndarray:
    known = worker_cache("words", WordHashes)
    return np.array([known[w] for w in words], np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the text in lower case (A-Z)."""
    return hashes(plain_words(ascii_lower(text)))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than width are one shingle, none are none."""
    n = len(words)
    if not n:
        return words
    length = min(n, width)
    h = np.full(n - length + 1, length, np.uint64)
    for k in range(length):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - length + k + 1])
    return np.unique(h)


def fragments(spark: SparkSession) -> int:
    """Fragments of the hash range; they follow the number of shuffle partitions, which follows the input."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_fragment(grams: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the features by fragment, stable within it, and where each fragment begins in that order."""
    frag = fragment_of(grams, count)
    order = np.argsort(frag, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(frag, minlength=count))])


def runs(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[len(who) > 0], who[1:] != who[:-1]]))
    return who[starts], np.diff(np.append(starts, len(who)))


def in_batches(rows: Iterator[dict], names: list[str]) -> Iterator[dict]:
    """Rows as batches of PACKED_ROWS."""
    out: dict[str, list] = {n: [] for n in names}
    for row in rows:
        for n in names:
            out[n].append(row.get(n))
        if len(out[names[0]]) == PACKED_ROWS:
            yield out
            out = {n: [] for n in names}
    if out[names[0]]:
        yield out


def fragment_of(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.int64)


def blocks(batches: Iterator[dict], features_of, size: int = BLOCK_FEATURES) -> Iterator[tuple[int, list, list[np.ndarray]]]:
    """(block id, ids, feature arrays); block ids are unique and the same whenever a partition is computed again."""
    part, number, ids, found, total = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for i, text in zip(b["doc_id"], b["text"], strict=True):
            ids.append(i)
            found.append(features_of(text))
            total += len(found[-1]) + 16
            if total >= size:
                yield part << 32 | number, ids, found
                number, ids, found, total = number + 1, [], [], 0
    if ids:
        yield part << 32 | number, ids, found
