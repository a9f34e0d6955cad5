"""Embedding profiles, vectors at length 1: some that need no model file, others by an encoder that a worker loads once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.vectors import unit
from skein.sources.store import ConcurrentWrite

Encoder = Callable[[list[str]], np.ndarray]
Loader = Callable[[], Encoder]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Profile:
    profile_id: str
    dimension: int
    query_prefix: str = ""
    document_prefix: str = ""


PROFILES = {p.profile_id: p for p in (Profile("hash", 1024), Profile("hashing-tf", 256), Profile("letters", 26), Profile("letters-e5", 26, "query: ", "passage: "), Profile("hashing-tf-e5", 256, "query: ", "passage: "))}


def profile(name: str, **custom: object) -> Profile:
    """A registered profile; "custom" needs its dimension and may set prefixes, and is registered under its profile_id."""
    name = (name or "").strip().lower()
    if name == "custom":
        if not custom.get("dimension"):
            raise ValueError("a custom profile needs its dimension")
        made = Profile(**{"profile_id": "custom", **custom})
        PROFILES[made.profile_id] = made
        return made
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}, custom")
    return PROFILES[name]


def listed(spark: SparkSession) -> DataFrame:
    """All profiles: profile_id, dimension, query_prefix, document_prefix."""
    return spark.createDataFrame([(p.profile_id, p.dimension, p.query_prefix, p.document_prefix) for p in PROFILES.values()], "profile_id string, dimension int, query_prefix string, document_prefix string")


def profile_key(key: str, profile: str, baseline: str = "hash") -> str:
    return key if profile == baseline else f"{key}__emb_{re.sub(r'[^A-Za-z0-9_.-]', '_', profile)}"


#: Profiles with a model: what loads it, in order, and a name of the registration.
LOADERS: dict[str, tuple[str, tuple[Loader, ...]]] = {}
_LOADED: dict[str, Encoder] = {}


def register(made: Profile, *loaders: Loader) -> Profile:
    """A profile whose vectors a model makes. Each loader returns an encoder (list of texts -> array, a row each) or raises;
    the first that returns one serves, so a local folder may stand before a hub, and a device before another. Loaders go to
    the workers: they and what they name must be there."""
    if not loaders:
        raise ValueError("a profile with a model needs a loader")
    PROFILES[made.profile_id] = made
    LOADERS[made.profile_id] = (uuid.uuid4().hex, loaders)
    return made


def loaded(name: str, loaders: tuple[Loader, ...]) -> Encoder:
    """The encoder of a registration, loaded once a worker; another registration takes its place in memory."""
    if name not in _LOADED:
        faults = []
        for load in loaders:
            try:
                found = load()
            except Exception as e:  # noqa: BLE001 - whatever a library raises, the next loader is tried
                faults.append(f"{type(e).__name__}: {e}")
                continue
            _LOADED.clear()
            _LOADED[name] = found
            break
        else:
            raise RuntimeError(f"no loader gave a model: {'; '.join(faults)}")
    return _LOADED[name]


def letter_counts(text: Column) -> Column:
    """Profile letters: how often each letter stands in the text; built-in functions only."""
    counts = lambda low: F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    return F.transform(F.array(F.lower(text)), counts)[0]  # the lambda variable holds the lowered text once


def _digest_vector(text: str, n: int) -> np.ndarray:
    raw = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)
    return np.resize(raw, n).astype(float)


def _tf_vector(text: str, n: int) -> np.ndarray:
    out = np.zeros(n)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % n] += 1 - 2 * (h >> 63)
    return out


def embed(text: Column, profile: str = "hashing-tf", query: bool = False) -> Column:
    p = PROFILES[profile]
    full = F.concat(F.lit(p.query_prefix if query else p.document_prefix), F.coalesce(text, F.lit("")))
    if profile in ("letters", "letters-e5"):
        return unit(letter_counts(full))
    if profile in LOADERS:
        name, loaders = LOADERS[profile]
        vectors = lambda texts: np.asarray(loaded(name, loaders)(texts), float).reshape(len(texts), p.dimension)
    else:
        make = _digest_vector if profile == "hash" else _tf_vector
        vectors = lambda texts: [make(t, p.dimension) for t in texts]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([(v / (np.linalg.norm(v) or 1)).astype(np.float32) for v in vectors(s.tolist())])

    return run(full)


#: Times that vectors are put beside what other writers have added meanwhile; hashes of texts up to which they go to every
#: task (some 100 bytes each).
TRIES, SENT = 5, 100_000
SHARED, VECTORS_BY_CONTENT = "embeddings", "bucket int, profile string, text_hash string, embedding array<float>"


class SharedEmbeddings:
    """Vectors by (profile, hash of the text), kept once for all collections of a store: a text that any of them has had
    embedded needs no model again. Laid out by buckets of the hash; only buckets that gain texts are rewritten."""

    def __init__(self, store, buckets: int = 64):
        self.store, self.buckets = store, buckets

    def of(self, chunks: DataFrame, profile: str = "hashing-tf", text: str = "source") -> DataFrame:
        """chunks with embedding. Missing texts are embedded, each once, and kept before the vectors are joined."""
        self.add(chunks, profile, text)
        own = self.store.read(SHARED, "vectors", VECTORS_BY_CONTENT).where(F.col("profile") == profile).select(F.col("text_hash").alias("_hash"), "embedding")
        return chunks.withColumn("_hash", self._hash(text)).join(own, "_hash", "left").drop("_hash")

    def _hash(self, text: str) -> Column:
        return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)

    def add(self, chunks: DataFrame, profile: str, text: str = "source") -> int:
        """Embeds the texts that have no vector of the profile yet; how many those were."""
        change = self.store.change(SHARED)
        known = change.read("vectors", VECTORS_BY_CONTENT).where(F.col("profile") == profile).select("text_hash")
        texts = chunks.select(self._hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        if "vectors" in change.tables:  # hashes alone tell what is missing; only texts that are go through a shuffle
            wanted = change.stage(texts.select("text_hash").distinct().join(known, "text_hash", "left_anti"), "missing")
            n = wanted.count()
            if not n:
                return 0
            texts = texts.join(F.broadcast(wanted) if n <= SENT else wanted, "text_hash", "left_semi")
        missing = texts.groupBy("text_hash").agg(F.any_value("t").alias("t"))
        bucket = F.pmod(F.xxhash64("text_hash"), F.lit(self.buckets)).cast("int")
        made = missing.select(bucket.alias("bucket"), F.lit(profile).alias("profile"), "text_hash", embed(F.col("t"), profile).cast("array<float>").alias("embedding"))
        fresh = change.stage(made, "new")  # the model runs once, whatever is done with its vectors
        added = {r["bucket"]: r["count"] for r in fresh.groupBy("bucket").count().collect()}  # at most self.buckets rows
        for attempt in range(TRIES if added else 0):
            old = change.read("vectors", VECTORS_BY_CONTENT, buckets=sorted(added))
            new = fresh.join(old.select("profile", "text_hash"), ["profile", "text_hash"], "left_anti").select(*old.columns)
            change.replace_buckets(old.unionByName(new), set(added), "vectors")
            try:
                change.commit()
                break
            except ConcurrentWrite:  # another collection's texts came first; they may be among these
                if attempt == TRIES - 1:
                    raise
                change = self.store.change(SHARED)
        return sum(added.values())
