"""Operator 4: best-fit packing by a grouping genetic algorithm on islands.

A document longer than a sequence is cut so that only its first piece is shorter; whole-length pieces fill
sequences of their own, the other pieces are items of a bin-packing problem. Items are dealt into groups by a hash.
For each group several islands evolve populations of groupings: crossover injects the partner's well-filled bins
whole, drops bins that then hold an item twice, lets displaced items change places with shorter ones of fuller bins, and
best-fits the rest. After each epoch the islands' best groupings migrate along a ring. An island rests as soon as a
grouping has no more bins than any must have; that grouping goes to all islands, so the whole group rests. Bins that stay
poorly filled give their items back, and these are packed again in fewer groups, so that the groups' borders cost little.

Defined results: a null or empty text is the end id alone; rows with the same doc_id are separate items, and their
pieces keep separate offsets; a null doc_id is packed like others; a text of any length is cut, never shortened; an empty
table gives an empty one; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import arrow_map, doc_texts, small_batches, staged
from skein.llm.tokens import encode

CAPACITY, END = 2048, 0
#: Items of a group, islands, epochs between migrations, crossovers of an island in an epoch, groupings of an island.
GROUP_ITEMS, ISLANDS, EPOCHS, CROSSOVERS, POPULATION = 1500, 3, 3, 8, 5
#: A bin filled at least so far is injected; one filled less is packed again with those of other groups.
WELL_FILLED, GOOD_ENOUGH = 0.95, 0.97
REPACKS = 3

Bins = list[list[int]]  # lengths of the items of each bin; items of one length can stand for one another


def best_fit(bins: Bins, items: list[int], capacity: int = CAPACITY) -> Bins:
    """Items, longest first, each into the fullest bin that has room."""
    out = [list(b) for b in bins]
    room = sorted((capacity - sum(b), i) for i, b in enumerate(out))
    for x in sorted(items, reverse=True):
        at = bisect_left(room, (x, -1))
        if at < len(room):
            left, i = room.pop(at)
        else:
            left, i = capacity, len(out)
            out.append([])
        out[i].append(x)
        insort(room, (left - x, i))
    return out


def fitness(bins: Bins, capacity: int = CAPACITY) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (squares reward uneven filling)."""
    return (-len(bins), sum([(x / capacity) ** 2 for x in map(sum, bins)]))


def least_bins(bins: Bins, capacity: int = CAPACITY) -> int:
    """No grouping of the items has fewer bins: their sum, and the items too long to share a bin, ask for that many."""
    items = [x for b in bins for x in b]
    return max(-(-sum(items) // capacity), sum(2 * x > capacity for x in items))


def exchange(bins: Bins, free: list[int], rng: np.random.Generator, capacity: int = CAPACITY) -> tuple[Bins, list[int]]:
    """Items change places with longer free ones where the bin has room for them: bins get fuller, free items shorter."""
    free = sorted(free)
    for i in rng.permutation(len(bins)).tolist():
        own, room = bins[i], capacity - sum(bins[i])
        for k, x in enumerate(own):
            if not room or not free:
                break
            at = bisect_right(free, x + room) - 1
            if at >= 0 and free[at] > x:
                y = free.pop(at)
                own[k], room = y, room - (y - x)
                insort(free, x)
    return bins, free


def _refill(bins: Bins, free: list[int], rng: np.random.Generator, capacity: int) -> Bins:
    kept, left = exchange([list(b) for b in bins], free, rng, capacity)
    return best_fit(kept, left, capacity)


def crossover(a: Bins, b: Bins, rng: np.random.Generator, capacity: int = CAPACITY) -> Bins:
    """A child: the partner's well-filled bins whole, a's bins whose items are still free, the rest put in again."""
    full = sorted(b, key=sum, reverse=True)[: max(1, len(b) // 2)]
    take = [x for x, keep in zip(full, rng.random(len(full)) < 0.6, strict=True) if keep and sum(x) >= WELL_FILLED * capacity or sum(x) == capacity]
    free = Counter(chain.from_iterable(a))
    for g in take:
        for x in g:
            free[x] -= 1
    child, displaced = [list(g) for g in take], []
    order = sorted(range(len(a)), key=list(map(sum, a)).__getitem__, reverse=True)
    for i in order:
        for at, x in enumerate(a[i]):
            if not free[x]:  # an item is gone: those before it are given back
                for y in a[i][:at]:
                    free[y] += 1
                break
            free[x] -= 1
        else:
            child.append(list(a[i]))
    for x, n in free.items():
        displaced += [x] * n
    return _refill(child, displaced, rng, capacity)


def mutate(a: Bins, rng: np.random.Generator, capacity: int = CAPACITY) -> Bins:
    """Empties the least filled bins and a few others, and puts their items in again."""
    order = sorted(range(len(a)), key=lambda i: sum(a[i]))
    gone = set(order[: max(1, len(a) // 20)]) | set(rng.choice(len(a), max(1, len(a) // 20), replace=False).tolist())
    return _refill([a[i] for i in range(len(a)) if i not in gone], [x for i in gone for x in a[i]], rng, capacity)


def first(items: list[int], rng: np.random.Generator, capacity: int = CAPACITY) -> Bins:
    """A grouping to begin with: a random part of the items is packed first, the rest around it."""
    part = rng.random(len(items)) < 0.5
    return best_fit(best_fit([], [x for x, p in zip(items, part, strict=True) if p], capacity), [x for x, p in zip(items, part, strict=True) if not p], capacity)


def evolve(population: list[Bins], seed: int, capacity: int = CAPACITY) -> list[Bins]:
    """One epoch of one island; the best grouping stands first. A grouping that no other can beat ends it."""
    rng = np.random.default_rng(seed)
    least = least_bins(population[0], capacity)
    ranked = lambda found: sorted(found, key=lambda x: x[0], reverse=True)
    known = lambda x: (fitness(x, capacity), x)
    best = ranked(map(known, population))
    for _ in range(CROSSOVERS):
        if len(best[0][1]) <= least:
            break
        mate = best[int(rng.integers(1, len(best)))][1] if len(best) > 1 else best[0][1]
        one, two = (best[0][1], mate) if rng.random() < 0.5 else (mate, best[0][1])
        child = crossover(one, two, rng, capacity)
        best = ranked([*best, known(child), known(mutate(child, rng, capacity))])[:POPULATION]
    return [x for _, x in best]


def start_of(items: list[int], island: int, rng: np.random.Generator, capacity: int = CAPACITY) -> list[Bins]:
    """An island's first groupings; the first island has that of best-fit decreasing among them."""
    made = [best_fit([], items, capacity)] if not island else []
    if made and len(made[0]) <= least_bins(made[0], capacity):
        return made
    return made + [first(items, rng, capacity) for _ in range(POPULATION - len(made))]


ISLAND = T.StructType([T.StructField("grp", T.LongType()), T.StructField("island", T.IntegerType()), T.StructField("lengths", T.BinaryType()), T.StructField("bins", T.ArrayType(T.BinaryType()))])


def _dump(bins: Bins) -> bytes:
    return np.array([x for b in bins for x in [*b, 0]], "<u2").tobytes()  # 0 ends a bin


def _parse(raw: bytes) -> Bins:
    out: Bins = [[]]
    for x in np.frombuffer(raw, "<u2").tolist():
        if x:
            out[-1].append(x)
        else:
            out.append([])
    return out[:-1]


def _epoch(islands: DataFrame, epoch: int, last: bool) -> DataFrame:
    """Every island after an epoch: its groupings and, but for the last epoch, its best one for the next island of the
    ring, or for all islands if no grouping can have fewer bins. Both leave in one pass, so no epoch is run twice."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            made: dict[str, list] = {f.name: [] for f in ISLAND}
            for grp, island, lengths, bins in zip(b["grp"], b["island"], b["lengths"], b["bins"], strict=True):
                items = np.frombuffer(lengths, "<u2").tolist()
                seed = (grp * 1009 + island * 31 + epoch) % 2**63
                rng = np.random.default_rng(seed)
                began = [_parse(x) for x in bins] if bins else start_of(items, island, rng)
                population, least = evolve(began, seed + 1), least_bins(began[0])
                rests = len(population[0]) <= least
                found = [_dump(x) for x in population[: 1 if rests else None]]
                rested = bins and min(map(len, began)) <= least  # the others know
                told = [] if last or rested else [(island + k) % ISLANDS for k in range(1, ISLANDS if rests else 2)]
                for to, which in [(island, found), *[(k, found[:1]) for k in told]]:
                    for name, v in zip(made, (grp, to, lengths, which), strict=True):
                        made[name].append(v)
            yield made

    return arrow_map(islands, rows, ISLAND)


def _pack_groups(items: DataFrame, group_items: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """items: item_id, length, grp. Packed rows (item_id, length, grp, bin, offset, filled) of the best grouping per group."""
    grouped = items.groupBy("grp").agg(F.collect_list("length").alias("all"))  # a group holds about GROUP_ITEMS items by its hash

    def start(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            made: dict[str, list] = {f.name: [] for f in ISLAND}
            for grp, lengths in zip(b["grp"], b["all"], strict=True):
                items = sorted(lengths)
                plain = best_fit([], items)
                rests = len(plain) <= least_bins(plain)  # one island is enough where nothing is left to find
                for island in range(1 if rests else ISLANDS):
                    for name, v in zip(made, (grp, island, np.array(items, "<u2").tobytes(), [_dump(plain)] if rests else []), strict=True):
                        made[name].append(v)
            yield made

    islands = arrow_map(grouped, start, ISLAND).repartition(F.col("grp"), F.col("island"))
    for epoch in range(EPOCHS):
        islands = _epoch(islands, epoch + 100 * salt, epoch + 1 == EPOCHS)
        if epoch + 1 < EPOCHS:
            islands = islands.groupBy("grp", "island").agg(F.first("lengths").alias("lengths"), F.flatten(F.collect_list("bins")).alias("bins"))
    best = islands.select("grp", F.col("bins")[0].alias("best")).groupBy("grp").agg(F.collect_list("best").alias("best"))
    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("filled", T.IntegerType())])

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bins = max((_parse(bytes(x)) for x in right["best"].iloc[0]), key=fitness)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        for i, b in enumerate(bins):
            at, filled = 0, sum(b)
            for x in b:
                slots.setdefault(x, []).append((i, at, filled))
                at += x
        left = left.sort_values(["length", "item_id"])
        got = [slots[x].pop() for x in left["length"].tolist()]
        return pd.DataFrame({"grp": key[0], "item_id": left["item_id"].to_numpy(), "length": left["length"].to_numpy(), "bin": [g[0] for g in got], "offset": [g[1] for g in got], "filled": [g[2] for g in got]})

    return items.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(assign, schema)


def pack(items: DataFrame, n_items: int) -> DataFrame:
    """items: item_id (distinct), length (1 to CAPACITY - 1). Adds sequence_id and offset; sequences are gapless."""
    done, left = None, items
    size = n_items
    for turn in range(REPACKS + 1):
        groups = max(1, -(-size // GROUP_ITEMS))
        # by the tail of the hash another deal each turn
        packed = staged(_pack_groups(left.withColumn("grp", F.pmod(F.xxhash64("item_id", F.lit(turn)), F.lit(groups))), GROUP_ITEMS, turn), f"pack{turn}")
        last = turn == REPACKS or groups == 1
        good = packed if last else packed.where(F.col("filled") >= int(GOOD_ENOUGH * CAPACITY))
        # number: turn, group and bin in separate bits
        part = good.select("item_id", (F.col("grp") * 65536 + F.col("bin") + F.lit(turn + 1) * (1 << 56)).cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = packed.where(F.col("filled") < int(GOOD_ENOUGH * CAPACITY)).select("item_id", "length")
        size = left.count()
        if not size:
            break
    return done


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n (row number within the partition), piece, start, length, ids_crc32 of every piece of every document."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")])
    end = np.array([END], "<u4").tobytes()

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, raw in zip(b["doc_id"], encode(b["text"], path), strict=True):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % CAPACITY or CAPACITY, n + 1, CAPACITY)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, v in zip(out, (doc, k, s, e - s, zlib.crc32(raw[4 * s : 4 * e])), strict=True):
                        out[name].append(v)
            yield out

    return arrow_map(docs, rows, schema)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    # ids of rows are fixed by writing them: a recomputed partition could number its rows otherwise
    cut = staged(pieces(doc_texts(docs), path).withColumn("item_id", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < CAPACITY).select("item_id", F.col("length").cast("int").alias("length"))
    numbers = pack(items, items.count())
    whole = cut.where(F.col("length") == CAPACITY).select("*", F.col("item_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = cut.where(F.col("length") < CAPACITY).join(numbers, "item_id").unionByName(whole)
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
