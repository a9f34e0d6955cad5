"""The k best of each query within a task, kept while batches stream by, so that a shuffle sees k rows a query and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], columns: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a matrix of a slice's rows x columns has at most so many cells."""
    step = max(1, cells // max(1, columns))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def first_of_each(query: np.ndarray, value: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (value, ident) of each query."""
    order = np.lexsort((ident, value, query))
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[len(q) > 0], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


class TopK:
    """Smallest values first, ties by ident."""

    def __init__(self, queries: int, k: int):
        self.k, self.worst, self.found = k, np.full(queries, np.inf), None

    def add(self, values: np.ndarray, idents: np.ndarray) -> None:
        """values: queries x rows, inf where a row is no hit; idents: of the rows."""
        limit = self.worst
        if values.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(values, self.k - 1, axis=1)[:, self.k - 1])
        query, row = np.nonzero((values <= limit[:, None]) & (values < np.inf))
        new = (query, values[query, row], idents[row])
        if self.found is not None:
            new = tuple(np.concatenate(x) for x in zip(self.found, new, strict=True))
        keep = first_of_each(*new, self.k)
        self.found = tuple(x[keep] for x in new)
        query, value, _ = self.found
        full = np.bincount(query, minlength=len(self.worst)) >= self.k
        last = np.full(len(self.worst), -np.inf)
        np.maximum.at(last, query, value)
        self.worst = np.where(full, last, np.inf)
