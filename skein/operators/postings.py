"""Kept postings of the lexical channel: which blocks of chunks can hold a question's best chunks at all.

Chunks of a collection lie in blocks of neighbours (by path) within their bucket. For every block and every two or three
characters that occur in it a posting says how often a chunk has them at most, and in which of path, name, parent and
language they stand. A keyword occurs where all its pieces of three do, and no more often than the rarest of them, so a
question's score in a block has an upper bound that postings alone give. The blocks of greatest bound are read and scored
first; of the others only those whose bound reaches the k-th score found so far. Scores and order are those of
lexical.lexical_topk over all chunks.

Tables `lexical-texts` (chunks with their block, sorted by it, in small row groups) and `lexical-grams` are laid out by the
buckets of the chunks, so that a change of files rewrites only the buckets that the chunks themselves rewrite.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skein.operators.lexical import MOST, OCCURRENCE, POINTS, lexical_topk, query_keywords, ranked
from skein.sources.store import Change, Store, bucket_of

#: Chunks of a block; blocks a question reads first; blocks up to which they are named in a filter that row groups are
#: pruned by; bytes of a row group.
BLOCK, FIRST, NAMED, ROW_GROUP = 64, 2, 2000, 1 << 20
TEXTS, GRAMS = "lexical-texts", "lexical-grams"
_FIELDS = tuple(POINTS)
_GRAMS = "bucket int, block int, gram string, most int, " + ", ".join(f"{f} boolean" for f in _FIELDS)


def pieces(word: str) -> list[str]:
    """What of a keyword is looked up: its pieces of three characters, or itself if it is shorter."""
    return sorted({word[i : i + 3] for i in range(len(word) - 2)}) if len(word) > 3 else [word]


def _counted(texts: DataFrame) -> DataFrame:
    """The postings of texts that come block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, known = None, {}
        for b in batches:
            for r in b.itertuples(index=False):
                if (r.bucket, r.block) != key:
                    yield from told(key, known)
                    key, known = (r.bucket, r.block), {}
                own: dict[str, int] = {}
                for n in (2, 3):
                    for i in range(len(r.source) - n + 1):
                        own[r.source[i : i + n]] = own.get(r.source[i : i + n], 0) + 1
                for gram, count in own.items():
                    if count > (held := known.setdefault(gram, [0, *[False] * len(_FIELDS)]))[0]:
                        held[0] = count if count < MOST else MOST
                for at, text in enumerate((getattr(r, f) for f in _FIELDS), 1):
                    for n in (2, 3):
                        for i in range(len(text) - n + 1):
                            known.setdefault(text[i : i + n], [0, *[False] * len(_FIELDS)])[at] = True
        yield from told(key, known)

    def told(key: tuple | None, known: dict) -> Iterator[pd.DataFrame]:
        if known:
            rows = [(*key, gram, *held) for gram, held in known.items()]
            yield pd.DataFrame(rows, columns=["bucket", "block", "gram", "most", *_FIELDS])

    return texts.select("bucket", "block", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in (*_FIELDS, "source")]).mapInPandas(run, _GRAMS)


class Postings:
    """Postings of a collection's chunks (chunk_id, file_path, name, parent, language, source)."""

    def __init__(self, store: Store, collection: str):
        self.store, self.collection = store, collection
        self.read_blocks = self.all_blocks = 0  # of the last search

    def refresh(self, change: Change, touched: set[int] | None = None) -> None:
        """Makes the postings of the touched buckets (of all, if None) anew, from the chunks as the change has them."""
        now = change.tables["chunks"]
        chunks = change.read("chunks", buckets=None if touched is None else sorted(touched))
        own = chunks.select(bucket_of(max(1, now["buckets"])).cast("int").alias("bucket"), "chunk_id", *_FIELDS, "source")
        place = F.row_number().over(W.partitionBy("bucket").orderBy("file_path", "chunk_id")) - 1
        texts = own.select("*", F.floor(place / BLOCK).cast("int").alias("block"))
        if touched is None:
            change.write(texts, TEXTS, row_group=ROW_GROUP)
        else:
            change.replace_buckets(texts, touched, TEXTS, row_group=ROW_GROUP)
        written = change.read(TEXTS, buckets=None if touched is None else sorted(touched))
        dealt = written.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
        if touched is None:
            change.write(_counted(dealt), GRAMS)
        else:
            change.replace_buckets(_counted(dealt), touched, GRAMS)

    def build(self) -> None:
        change = self.store.change(self.collection)
        self.refresh(change)
        change.commit()

    def bounds(self, change: Change, words: DataFrame) -> DataFrame:
        """query_id, bucket, block, bound: the greatest score that a chunk of the block can have. words: query_id, kw."""
        own = words.select("kw").distinct()
        trigrams = F.transform(F.sequence(F.lit(1), F.char_length("kw") - 2), lambda i: F.col("kw").substr(i, F.lit(3)))
        looked = F.array_distinct(F.when(F.char_length("kw") > 3, trigrams).otherwise(F.array("kw")))
        asked = own.select("kw", F.size(looked).alias("pieces"), F.explode(looked).alias("gram"))
        met = change.read(GRAMS).join(asked, "gram").groupBy("bucket", "block", "kw", "pieces").agg(F.count("*").alias("found"), F.min("most").alias("most"), *[F.min(f).alias(f) for f in _FIELDS])
        # a keyword stands in a field or in the source only where all its pieces do
        points = F.col("most") * OCCURRENCE
        for field, p in POINTS.items():
            points = points + F.when(F.col(field), p).otherwise(0.0)
        return met.where("found = pieces").select("bucket", "block", "kw", points.alias("points")).where("points > 0").join(words, "kw").groupBy("query_id", "bucket", "block").agg(F.sum("points").alias("bound"))

    def _chunks(self, change: Change, blocks: DataFrame) -> DataFrame:
        """The chunks of these blocks (bucket, block): other buckets are not opened, other row groups not read."""
        few = blocks.limit(NAMED + 1).collect()
        buckets = sorted({r["bucket"] for r in few} if len(few) <= NAMED else {r[0] for r in blocks.select("bucket").distinct().collect()})
        own = change.read(TEXTS, buckets=buckets)
        if len(few) <= NAMED:
            own = own.where(F.col("block").isin(sorted({r["block"] for r in few})))
        return own.join(F.broadcast(blocks) if len(few) <= NAMED else blocks, ["bucket", "block"], "left_semi")

    def topk(self, questions: DataFrame, k: int = 8) -> DataFrame:
        """query_id, chunk_id, score, rank: as lexical_topk gives over all chunks."""
        change = self.store.change(self.collection)
        words = query_keywords(questions).persist()  # of a batch of questions
        bounds = self.bounds(change, words).persist()
        first = bounds.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("bound").desc(), "bucket", "block"))).where(F.col("r") <= FIRST)
        opened = first.select("bucket", "block").distinct().persist()
        hits = lexical_topk(self._chunks(change, opened), questions, k).persist()  # k rows a question
        last = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = bounds.join(last, "query_id", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0.0))).select("bucket", "block").distinct()
        rest = rest.join(opened, ["bucket", "block"], "left_anti").persist()
        n = rest.count()
        self.read_blocks, self.all_blocks = opened.count() + n, change.read(GRAMS).select("bucket", "block").distinct().count()
        if n:
            more = lexical_topk(self._chunks(change, rest), questions, k)
            hits = ranked(hits.drop("rank").unionByName(more.drop("rank")), k, [F.col("score").desc(), F.col("chunk_id")])
        return hits
