"""Index a repository: scan, diff, chunk, embed, upsert, then tracker and manifest, in this order."""

from __future__ import annotations

import datetime
import hashlib
import os
import time
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import agent, context, embed, evaluation, fusion, lexical, postings, vectors
from skein.operators.cells import Cells
from skein.operators.chunking import chunk_files
from skein.operators.postings import Postings
from skein.sinks.model import Model, Piece
from skein.sources import repository
from skein.sources import scan as scanning
from skein.sources.store import STATS, Store, change_set, manifest_status, merged

TRACKER = "rel_path string, file_hash string"
MANIFEST = "collection string, display_name string, source string, profile string, files long, chunks long, chunk_types map<string,long>, last_indexed_at string"


def local_key(path: str) -> str:
    return hashlib.sha256(os.path.abspath(os.path.expanduser(path)).encode()).hexdigest()[:12]


def git_key(url: str, ref: str | None = None) -> str:
    return f"git-{hashlib.sha256(url.removesuffix('.git').encode()).hexdigest()[:8]}-{(ref or 'DEFAULT').replace('/', '_')}"


def resolve(source: str, ref: str | None = None) -> tuple[str, str, str]:
    """(kind, canonical source, key) of what a user names; nothing is cloned or opened."""
    if repository.kind(source) == "git":
        url = repository.canonical(source)
        return "git", url, git_key(url, ref)
    return "local", os.path.abspath(os.path.expanduser(source)), local_key(source)


MODES = ("vector", "lexical", "hybrid")


def parse_mode(mode: str) -> str:
    found = (mode or "").strip().lower()
    if found not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    return found


def parse_modes(listed: str) -> list[str]:
    """Modes of a comma-separated list, each once, in order; empty entries are passed over."""
    return list(dict.fromkeys(parse_mode(m) for m in (listed or "").split(",") if m.strip()))


def collection_name(key: str) -> str:
    if not key:
        raise ValueError("empty collection key")
    plain = len(key) == 12 and all(c in "0123456789abcdef" for c in key)
    return f"skein-{key if plain else hashlib.sha256(key.encode()).hexdigest()[:12]}"


def index(spark: SparkSession, root: str, store: Store, profile: str = "hashing-tf", source: str | None = None, key: str | None = None, keep_postings: bool = False) -> dict:
    """Counts of what changed in a folder since it was last indexed; see _update()."""
    name = collection_name(embed.profile_key(key or local_key(root), profile))
    listed = scanning.listed(spark, root)
    hashes = scanning.contents(listed).select("rel_path", "file_hash")  # no contents are kept

    def changed(paths: DataFrame) -> DataFrame:
        # the files that changed are read once more: a path meets its change before its bytes are read
        build = listed.join(paths, "rel_path")
        docs, code = (scanning.contents(build.where(kind)) for kind in ("language = 'doc'", "language <> 'doc'"))  # each file once
        return chunk_files(docs, kind="doc").unionByName(chunk_files(code, kind="code"))

    return _update(store, name, hashes, changed, profile, os.path.basename(os.path.abspath(root)), source or os.path.abspath(root), keep_postings)


def index_table(files: DataFrame, store: Store, name: str, profile: str = "hashing-tf", source: str = "", keep_postings: bool = False) -> dict:
    """As index(), of files that are rows: rel_path, language (doc, or that of code; null: not indexed), content. Sensitive
    documents are left out as in a scan; of several rows of a path the one of greatest hash counts."""
    raw = files.where("rel_path IS NOT NULL AND language IS NOT NULL AND content <> ''").select("rel_path", "language", F.col("content").cast("binary").alias("raw"))
    found = scanning.described(raw)
    hashes = found.groupBy("rel_path").agg(F.max("file_hash").alias("file_hash"))

    def changed(paths: DataFrame) -> DataFrame:
        # a path has one hash here, so the rows that the join has dealt out are not dealt again to drop repeated ones
        own = found.join(paths.join(hashes, "rel_path"), ["rel_path", "file_hash"]).dropDuplicates(["rel_path", "file_hash"])
        return chunk_files(own)

    return _update(store, name, hashes, changed, profile, name, source, keep_postings)


def _update(store: Store, name: str, hashes: DataFrame, changed: Callable[[DataFrame], DataFrame], profile: str, shown: str, source: str, keep_postings: bool) -> dict:
    """Counts of what changed. Without changes nothing is written; chunks, tracker and manifest become visible at once, and so
    do postings, which are kept up once a collection has them (keep_postings). Texts whose vectors of the profile any
    collection of the store has are not embedded again. changed: paths (rel_path) to the chunks of those files."""
    change, spark = store.change(name), store.spark
    hashes = hashes.cache()
    changes = change_set(hashes, change.read("tracker", TRACKER)).cache()
    n = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}
    result = {"collection": name, **{k: n.get(k, 0) for k in ("added", "modified", "deleted")}}
    if n:
        new = change.stage(changed(changes.where("status IN ('added', 'modified')").select("rel_path")), "new")
        new = embed.SharedEmbeddings(store).of(new, profile)
        before = "chunks" in change.tables
        touched = change.replace_files(changes.select(F.col("rel_path").alias("file_path")), new)
        if keep_postings or postings.GRAMS in change.tables:
            Postings(store, name).refresh(change, touched if before and postings.GRAMS in change.tables else None)
        change.write(hashes, "tracker")
        types = {r["chunk_type"]: r["n"] for r in merged(change.read("chunks-stats", STATS), "chunk_type").collect()}
        now = datetime.datetime.now().isoformat(timespec="seconds")
        row = (name, shown, source, profile, hashes.count(), sum(types.values()), types, now)
        change.write(spark.createDataFrame([row], MANIFEST), "manifest")
        change.commit()
        result |= {"chunks": sum(types.values())}
    changes.unpersist()
    hashes.unpersist()
    return result


def search(
    chunks: DataFrame, questions: DataFrame, mode: str = "hybrid", k: int = 8, profile: str = "hashing-tf", threshold: float = 0.7, max_distance: float | None = None,
    lookup: Callable[..., DataFrame] | None = None, near: Callable[[DataFrame, int], DataFrame] | None = None, words: Callable[[DataFrame, int], DataFrame] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, tolerant: bool = False,
) -> DataFrame:
    """query_id, rank, score, stage, channels and the chunk's columns of a batch of questions (query_id, question).

    max_distance drops farther neighbours before boost and threshold. What a stored collection does better than a scan may
    be put in: lookup(rows, *columns) joins columns of chunks to rows of their ids, near(queries, n) and words(questions, n)
    give the n best of a channel (query_id, chunk_id, distance or score, rank). rerank gets the hits of the mode, as many
    as are fetched, and gives query_id, chunk_id, score, rank of those that stay. With `tolerant` a channel of the hybrid mode
    that fails gives no hits instead, with a warning, unless both fail: channels are computed at once then."""
    mode = parse_mode(mode)
    if k < 1:
        raise ValueError("k is at least 1")
    columns = [c for c in chunks.columns if c not in ("chunk_id", "embedding")]
    lookup = lookup or (lambda rows, *wanted: rows.join(chunks.select("chunk_id", *wanted), "chunk_id"))
    near = near or (lambda asked, n: vectors.vector_topk(chunks.select("chunk_id", "embedding"), asked, n))
    words = words or (lambda asked, n: lexical.lexical_topk(chunks, asked, n))

    def vector(n: int) -> DataFrame:
        found = near(questions.select("query_id", embed.embed(F.col("question"), profile, True).alias("embedding")), vectors.candidates(n))
        found = found if max_distance is None else found.where(F.col("distance") <= max_distance)
        asked = questions.select("query_id", vectors_keywords().alias("kws"))
        named = F.lower(F.concat_ws(" ", "file_path", "name", "parent", "language"))
        told = lookup(found, "file_path", "name", "parent", "language").withColumn("m", named).drop("file_path", "name", "parent", "language").join(asked, "query_id")
        cut = vectors.boost_and_cut(told, F.exists("kws", lambda w: F.col("m").contains(w)), n, threshold)
        return cut.select("query_id", "chunk_id", F.col("distance").alias("score"), F.col("final_rank").alias("rank"))

    fetched = k if rerank is None else vectors.candidates(k)
    if mode == "vector":
        hits = vector(fetched).withColumns({"stage": F.lit("vector"), "channels": F.lit("vector")})
    elif mode == "lexical":
        hits = words(questions, fetched).withColumns({"stage": F.lit("lexical"), "channels": F.lit("lexical")})
    else:
        channels = {"vector": lambda: vector(max(50, fetched)), "lexical": lambda: words(questions, max(50, fetched))}
        hits = fusion.rrf(_standing(channels) if tolerant else {n: make() for n, make in channels.items()}, fetched)
    if rerank is not None:
        hits = hits.transform(rerank).select("query_id", "chunk_id", "score", "rank").join(hits.select("query_id", "chunk_id", "stage", "channels"), ["query_id", "chunk_id"])
    return lookup(hits, *columns)


def _standing(channels: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The channels that can be computed, a few rows a question each; the fault of the last one if none can."""
    out, fault = {}, None
    for name, make in channels.items():
        try:
            hits = make().persist()
            hits.count()
            out[name] = hits
        except Exception as e:  # noqa: BLE001 - whatever fails in a channel, the other one may answer
            warnings.warn(f"the {name} channel failed and gives no hits: {str(e)[:200]}", stacklevel=2)
            fault = e
    if not out:
        raise fault
    return out


def search_stored(store: Store, collection: str, questions: DataFrame, mode: str = "hybrid", k: int = 8, threshold: float = 0.7, cells: str | None = None, certain: bool = True, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """search() over an indexed collection: metadata and sources are looked up for the candidates only, in the buckets of their
    files; questions are embedded by the collection's profile. Where the collection has postings the lexical channel reads
    only the blocks it needs, and with `cells` (a collection of vector cells) the vector channel only those cells."""
    change = store.change(collection)
    chunks, manifest = change.read("chunks"), change.read("manifest", MANIFEST).first()
    if chunks is None:
        raise ValueError(f"no collection {collection}")
    near = (lambda asked, n: Cells(store, cells).search(asked, n, certain=certain)) if cells else None
    words = (lambda asked, n: Postings(store, collection).topk(asked, n)) if postings.GRAMS in change.tables else None
    lookup = lambda rows, *columns: store.lookup(collection, rows, *columns)
    return search(chunks, questions, mode, k, manifest["profile"] if manifest else "hashing-tf", threshold, None, lookup, near, words, rerank)


def vectors_keywords():
    from skein.functions.text import keywords_vector

    return keywords_vector(F.col("question"))


def answer_context(hits: DataFrame, questions: DataFrame, mode: str = "hybrid") -> DataFrame:
    """query_id, context, low_confidence, reason."""
    return evaluation.confidence(hits, questions, mode).join(context.contexts(hits), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def ask(chunks: DataFrame, question: str, mode: str = "hybrid", k: int = 8, profile: str = "hashing-tf", threshold: float = 0.7) -> dict:
    """One question: its hits in order, their context, and whether they are a weak ground for an answer."""
    asked = chunks.sparkSession.createDataFrame([("q", question)], "query_id string, question string")
    hits = search(chunks, asked, mode, k, profile, threshold).cache()  # k rows, read twice
    told = answer_context(hits, asked, mode).first()
    rows = [r.asDict() for r in hits.orderBy("rank").collect()]
    hits.unpersist()
    return {"question": question, "hits": rows, "context": told["context"], "low_confidence": told["low_confidence"], "reason": told["reason"]}


def answer(chunks: DataFrame, question: str, model: Model, **how) -> dict:
    """ask(), and the model's answer."""
    found = ask(chunks, question, **how)
    return found | {"answer": model.generate(found["context"], question)}


def stream_answer(chunks: DataFrame, question: str, model: Model, **how) -> tuple[dict, Iterator[Piece]]:
    """ask(), and the pieces of the model's answer as they come."""
    found = ask(chunks, question, **how)
    return found, model.stream(found["context"], question)


def evaluate(chunks: DataFrame, golden: DataFrame, modes: list[str], k: int = 8, respect_query_mode: bool = False, profile: str = "hashing-tf") -> DataFrame:
    """Averages per mode of golden queries, one job for all; a query's own mode overrides where that is asked for."""
    out = None
    for m in dict.fromkeys(modes):
        hits = search(chunks, golden, m, k, profile).select(F.lit(m).alias("mode"), "query_id", "rank", "file_path", "name", "parent")
        out = hits if out is None else out.unionByName(hits)
    metrics = evaluation.per_query(golden.select("query_id", "expected_files", "expected_symbols"), out, ["mode"])
    if respect_query_mode:
        own = golden.select("query_id", F.col("mode").alias("own"))
        metrics = metrics.join(own, "query_id").where(F.coalesce("own", "mode") == F.col("mode")).drop("own")
    return evaluation.summary(metrics, ["mode"])


def evaluate_one(chunks: DataFrame, golden: DataFrame, mode: str = "hybrid", k: int = 8, profile: str = "hashing-tf") -> tuple[DataFrame, DataFrame]:
    """(summary with average latency, metrics of each query) of one mode. All queries are one job: each is given an equal
    part of its time."""
    began = time.time()
    hits = search(chunks, golden, mode, k, profile).select("query_id", "rank", "file_path", "name", "parent")
    rows = evaluation.per_query(golden.select("query_id", "expected_files", "expected_symbols"), hits).collect()
    spark = golden.sparkSession
    schema = evaluation.per_query(golden.select("query_id", "expected_files", "expected_symbols"), hits).schema
    metrics = spark.createDataFrame(rows, schema).withColumn("elapsed_ms", F.lit(1000 * (time.time() - began) / max(1, len(rows))))
    return evaluation.with_latency(evaluation.summary(metrics), metrics, metrics.select("query_id", "elapsed_ms")), metrics


def compare_embeddings(store: Store, key: str, golden: DataFrame, profiles: list[str], mode: str = "hybrid", k: int = 8) -> DataFrame:
    """A row for each profile: the measures of its own index, or why there are none."""
    spark, out = golden.sparkSession, None
    for name in dict.fromkeys(profiles):
        profile = embed.profile(name)
        chunks = store.read(collection_name(embed.profile_key(key, profile.profile_id)))
        told = {"profile": F.lit(profile.profile_id), "dimension": F.lit(profile.dimension), "index_exists": F.lit(chunks is not None)}
        if chunks is None:
            one = spark.range(1).select(*[c.alias(n) for n, c in told.items()], F.lit(f"no index for this profile; run `index <source> --profile {profile.profile_id}`").alias("missing_reason"))
        else:
            one = evaluate(chunks, golden, [mode], k, profile=profile.profile_id).drop("mode").withColumns(told | {"missing_reason": F.lit("")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("name at least one profile")
    return out


def run_agent(chunks: DataFrame, task: str, profile: str = "hashing-tf", k: int = 5) -> dict:
    """Plan, hybrid evidence of all steps in one job, brief: a report for skein.sinks.reports."""
    steps = agent.plan(chunks.sparkSession.createDataFrame([("t", task)], "task_id string, task string"))
    found = search(chunks, steps.select(F.col("pos").alias("query_id"), "question"), "hybrid", k, profile)
    return agent.report(task, steps, found.withColumns({"task_id": F.lit("t"), "pos": F.col("query_id")}))


def run_agents(chunks: DataFrame, tasks: DataFrame, mode: str = "hybrid", profile: str = "hashing-tf", k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, evidence, briefs) of a batch of tasks (task_id, task): the steps of all plans are one batch of questions."""
    steps = agent.plan(tasks)
    asked = steps.select(F.concat_ws(":", F.col("task_id").cast("string"), F.col("pos").cast("string")).alias("query_id"), "question")
    found = search(chunks, asked, mode, k, profile)
    place = F.regexp_extract("query_id", ":([0-9]+)$", 1).cast("int").alias("pos")
    of = F.regexp_replace("query_id", ":[0-9]+$", "").cast(tasks.schema["task_id"].dataType).alias("task_id")
    evidence = found.select(of, place, *[c for c in found.columns if c != "query_id"])
    return steps, evidence, agent.briefs(steps, evidence)


def remove_manifest(store: Store, collection: str) -> bool:
    """Forgets one manifest; the chunks stay."""
    return store.drop(collection, "manifest")


def status(spark: SparkSession, store: Store, wanted: DataFrame) -> DataFrame:
    """status of the wanted collections (collection), from the manifests."""
    return manifest_status(wanted, manifests(spark, store))


def manifests(spark: SparkSession, store: Store) -> DataFrame:
    """All manifests, the latest first, in one read."""
    return store.everywhere("manifest", MANIFEST).orderBy(F.col("last_indexed_at").desc(), "collection")
