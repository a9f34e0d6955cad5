"""Word-for-word passages: which of a batch of items stand in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

try:
    import ahocorasick
except ImportError:  # without it seeds meet texts by a join
    ahocorasick = None

#: Characters of an item's beginning that are looked for first; items and their characters up to which they go to every task.
SEED, PASS_ITEMS, PASS_CHARS = 24, 100_000, 64 << 20


def passages(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id where the text holds the item, each pair once. items: item_id, item. texts: doc_id, text.

    The beginnings of the items are one automaton, sent to every task up to a checked size, which finds them in a text in
    time linear in it; where one stands the whole item is compared. Beyond the size seeds meet texts by an equi-join.
    Null and empty items and null texts are in no pair.
    """
    known = items.where("item <> ''").select("item_id", "item")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item")), F.lit(0)).alias("c")).first()
    kinds = f"item_id {dict(items.dtypes)['item_id']}, doc_id {dict(texts.dtypes)['doc_id']}"
    if ahocorasick is None or size["n"] > PASS_ITEMS or size["c"] > PASS_CHARS:
        return _by_join(known, texts)
    rows = [(r["item_id"], r["item"]) for r in known.collect()]
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    sent = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for ident, item in sent.value:
            by.setdefault(item[:SEED], []).append((ident, item))
        automaton = ahocorasick.Automaton()
        for seed, own in by.items():
            automaton.add_word(seed, (len(seed), own))
        if by:
            automaton.make_automaton()
        for batch in batches if by else ():
            found, docs = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = {ident for end, (n, own) in automaton.iter(text) for ident, item in own if text.startswith(item, end - n + 1)}
                found += mine
                docs += [doc] * len(mine)
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(found, item_type), "doc_id": pa.array(docs, batch.schema.field("doc_id").type)})

    return texts.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, kinds)


def _by_join(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Seeds at the beginnings of the items against all windows of the texts."""
    seeds = items.withColumn("seed", F.substring("item", 1, SEED))
    lengths = sorted({r[0] for r in seeds.select(F.length("seed")).distinct().collect()})  # at most SEED values

    def windows(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.col("text").substr(i, F.lit(n)))

    starts = F.array_distinct(F.flatten(F.array(*[windows(n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    met = texts.select("doc_id", "text", F.explode(starts).alias("seed")).join(seeds, "seed")
    return met.where(F.col("text").contains(F.col("item"))).select("item_id", "doc_id").distinct()
