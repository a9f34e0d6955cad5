"""Command line: index, search, ask, chat, list, status, remove, eval, agent, embeddings, cache."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import shortened
from skein.operators import agent, embed, evaluation
from skein.plans import index as plans
from skein.session import session
from skein.sinks import model, reports
from skein.sources import golden, repository
from skein.sources.clones import Clones
from skein.sources.store import Store, stats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    p.add_argument("--store", default=os.environ.get("SKEIN_STORE", ".skein"))
    p.add_argument("--master", default=os.environ.get("SKEIN_MASTER", "local[*]"))
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "ask", "chat", "status", "remove", "eval", "agent"):
        s = sub.add_parser(name)
        s.add_argument("source")
        if name in ("search", "ask", "agent"):
            s.add_argument("text")
        if name == "ask":
            s.add_argument("--context", action="store_true", help="print the context, call no model")
        s.add_argument("--profile", default="hashing-tf", choices=sorted(embed.PROFILES))
        s.add_argument("--ref")
        s.add_argument("--refresh", action="store_true")
        s.add_argument("--mode", default="hybrid")
        s.add_argument("--top-k", type=int, default=8)
        if name == "eval":
            s.add_argument("--dataset", required=True)
            s.add_argument("--compare-modes", default="")
            s.add_argument("--compare-embeddings", default="")
        if name in ("eval", "agent"):
            s.add_argument("--json")
            s.add_argument("--markdown")
    sub.add_parser("list")
    sub.add_parser("embeddings")
    sub.add_parser("cache").add_argument("action", choices=("list", "prune"))
    return p


def _report(report: dict, a: argparse.Namespace) -> None:
    """Prints a report, and writes it where that is asked for."""
    print(reports.markdown(report))
    for kind in reports.FORMATS:
        if getattr(a, kind):
            reports.write(report, getattr(a, kind), kind)


def _answer(chunks: DataFrame, question: str, a: argparse.Namespace, said: model.Model | None) -> None:
    """Streams the model's answer; without a model prints the context it would get."""
    how = {"mode": a.mode, "k": a.top_k, "profile": a.profile}
    if said is None:
        print(plans.ask(chunks, question, **how)["context"])
        return
    found, pieces = plans.stream_answer(chunks, question, said, **how)
    if found["low_confidence"]:
        print(f"weak evidence: {found['reason']}", file=sys.stderr)
    for p in pieces:
        print(p.content, end="", flush=True)
    print()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "embeddings":
        print(json.dumps({k: {"dimension": v.dimension, "query_prefix": v.query_prefix, "document_prefix": v.document_prefix} for k, v in embed.PROFILES.items()}))
        return 0
    clones = Clones(os.path.join(a.store, "clones"))
    if a.command == "cache" and a.action == "prune":
        print(json.dumps({"removed": clones.prune()}))
        return 0
    spark = session(a.master)
    store = Store(spark, a.store)
    if a.command == "cache":
        shown = clones.list(spark).withColumn("canonical_url", shortened(F.col("canonical_url")))
        for r in shown.collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return 0
    if a.command == "list":
        for r in plans.manifests(spark, store).collect():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return 0
    kind, source, key = plans.resolve(a.source, a.ref)
    name = plans.collection_name(embed.profile_key(key, a.profile))
    if a.command == "index":
        if kind == "git":
            root, commit = repository.checkout(a.source, clones.root, a.ref, a.refresh)
            clones.update(source, a.ref, commit)
        else:
            root = repository.local(a.source)
        print(json.dumps(plans.index(spark, root, store, a.profile, a.source, key)))
        return 0
    if a.command == "remove":
        print(json.dumps({"removed": store.delete(name)}))
        return 0
    if a.command == "eval" and a.compare_embeddings:
        golden_ = golden.load(spark, a.dataset)
        told = plans.compare_embeddings(store, key, golden_, [p.strip() for p in a.compare_embeddings.split(",") if p.strip()], a.mode, a.top_k)
        _report(reports.comparison(told, "profile", a.dataset, a.source, a.top_k), a)
        return 0
    chunks = store.read(name)  # nothing is cloned for a collection that is not there
    if chunks is None:
        print(json.dumps({"collection": name, "exists": False}))
        return 1
    if a.command == "status":
        print(json.dumps({r["chunk_type"]: r["n"] for r in stats(chunks).collect()}))
    elif a.command == "eval":
        wanted, modes = golden.load(spark, a.dataset), plans.parse_modes(a.compare_modes)
        if modes:
            _report(reports.comparison(plans.evaluate(chunks, wanted, modes, a.top_k, profile=a.profile), "mode", a.dataset, a.source, a.top_k), a)
        else:
            summary, metrics = plans.evaluate_one(chunks, wanted, a.mode, a.top_k, a.profile)
            _report(reports.evaluation(summary, metrics, a.dataset, a.source, a.top_k, a.mode), a)
            for r in evaluation.failed_samples(metrics).collect():
                print(f"no hit: {r['query_id']}")
    elif a.command == "agent":
        _report(plans.run_agent(chunks, a.text, a.profile), a)
    elif a.command == "ask":
        _answer(chunks, a.text, a, None if a.context else model.from_environment())
    elif a.command == "chat":  # each question on its own
        said, chunks = model.from_environment(), chunks.cache()
        for line in sys.stdin:
            if line.strip().lower() in ("exit", "quit", "q"):
                break
            if line.strip():
                _answer(chunks, line.strip(), a, said)
    else:
        asked = spark.createDataFrame([("q", a.text)], "query_id string, question string")
        hits = plans.search(chunks, asked, a.mode, a.top_k, a.profile)
        for r in hits.orderBy("rank").select("*", agent.hit_line().alias("line")).collect():
            print(f"{r['rank']}. {r['line']}  {r['score']:.4f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
