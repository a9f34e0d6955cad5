"""Report files of evaluations, comparisons and the agent: one description of a report, written as JSON or Markdown.

Reports are small: a row for each mode, profile or golden query. DataFrames are collected here and nowhere before.
"""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame

#: Columns of the measures, their titles, and how a report shows them.
MEASURES = (
    ("recall_at_1", "Recall@1", "{:.2%}"), ("recall_at_3", "Recall@3", "{:.2%}"), ("recall_at_8", "Recall@8", "{:.2%}"), ("mrr", "MRR", "{:.4f}"),
    ("file_hit_rate", "File hit rate", "{:.2%}"), ("symbol_hit_rate", "Symbol hit rate", "{:.2%}"), ("avg_latency_ms", "Avg latency (ms)", "{:.2f}"),
)
#: Decimal places in JSON; others have four.
PLACES = {"avg_latency_ms": 2, "elapsed_ms": 2}
FORMATS = ("json", "markdown")


def rounded(row: dict) -> dict:
    return {k: round(v, PLACES.get(k, 4)) if isinstance(v, float) else v for k, v in row.items()}


def _rows(df: DataFrame | None, order: list[str]) -> list[dict]:
    return [] if df is None else [rounded(r.asDict(recursive=True)) for r in df.orderBy(*order).collect()]


def evaluation(summary: DataFrame, per_query: DataFrame, dataset: str = "", repository: str = "", top_k: int = 8, mode: str = "vector") -> dict:
    """One summary row, and a row for each query."""
    return {
        "generated_at": datetime.datetime.now().isoformat(timespec="seconds"), "dataset": dataset, "repo_path": repository, "mode": mode, "top_k": top_k,
        "summary": _rows(summary, ["total"])[0], "per_query": _rows(per_query, ["query_id"]),
    }


def comparison(summaries: DataFrame, by: str, dataset: str = "", repository: str = "", top_k: int = 8) -> dict:
    """A row for each mode or profile; profiles without an index say why they have no measures."""
    return {
        "generated_at": datetime.datetime.now().isoformat(timespec="seconds"), "dataset": dataset, "repo_path": repository, "top_k": top_k, "by": by,
        f"{by}s": {r[by]: {k: v for k, v in r.items() if k != by} for r in _rows(summaries, [by])},
    }


def _cell(value: object, shape: str = "{}") -> str:
    text = "-" if value is None or value == "" else shape.format(value)
    return text.replace("|", "\\|").replace("\n", " ")


def _table(heads: list[str], rows: list[list[str]]) -> list[str]:
    return [f"| {' | '.join(heads)} |", f"|{'|'.join('---' for _ in heads)}|", *[f"| {' | '.join(r)} |" for r in rows], ""]


def _facts(report: dict) -> list[str]:
    names = (("generated_at", "Generated at"), ("dataset", "Dataset"), ("repo_path", "Repository"), ("mode", "Mode"), ("top_k", "top_k"))
    return [f"- {title}: {report[k]}" for k, title in names if k in report] + [""]


def markdown(report: dict) -> str:
    """The same report for people."""
    if "task" in report:
        return _agent(report)
    lines = [f"# Retrieval evaluation: {report.get('dataset') or 'unnamed'}", "", *_facts(report)]
    if "summary" in report:
        got = report["summary"]
        lines += ["## Summary", "", *_table(["Measure", "Value"], [[title, _cell(got.get(k), shape)] for k, title, shape in MEASURES])]
        heads = ["Query", "First hit", "RR", "File hit", "Symbol hit", "ms"]
        each = [[_cell(q.get("query_id")), _cell(q.get("first_hit_rank")), _cell(q.get("rr"), "{:.4f}"), _cell(q.get("file_hit")), _cell(q.get("symbol_hit")), _cell(q.get("elapsed_ms"), "{:.2f}")] for q in report["per_query"]]
        lines += ["## Queries", "", *_table(heads, each)]
    else:
        by = report["by"]
        every = report[f"{by}s"]
        lines += [f"## By {by}", "", *_table([by, *[t for _, t, _ in MEASURES]], [[_cell(name), *[_cell(r.get(k), shape) for k, _, shape in MEASURES]] for name, r in every.items()])]
        missing = [f"- {name}: {r['missing_reason']}" for name, r in every.items() if r.get("missing_reason")]
        lines += ["## Without an index", "", *missing, ""] if missing else []
    return "\n".join(lines).rstrip() + "\n"


def _agent(report: dict) -> str:
    def listed(title: str, items: list[str], code: bool = False) -> list[str]:
        shown = [f"- `{x}`" if code else f"- {x}" for x in items] or ["- None"]
        return [f"## {title}", "", *shown, ""]

    steps = [line for i, s in enumerate(report["plan"], 1) for line in (f"{i}. {s['question']}", *([f"   - {s['rationale']}"] if s["rationale"] else []))]
    lines = ["# Agent report", "", f"- Task: {report['task']}", f"- Insufficient evidence: {report['insufficient_evidence']}", "", "## Understanding", "", report["understanding"], "", "## Plan", "", *steps, ""]
    lines += listed("Key files", report["key_files"], True) + listed("Suggested changes", report["suggested_changes"]) + listed("Risks", report["risks"]) + listed("Suggested tests", report["suggested_tests"], True)
    lines += ["## Evidence", ""]
    for e in report["evidence"]:
        lines += [f"### {e['question']}", "", *([f"- `{x}`" for x in e["chunk_summaries"]] or ["- No evidence"]), ""]
    return "\n".join([*lines, "## Note", "", report["review_note"]]) + "\n"


def write(report: dict, path: str, kind: str) -> str:
    """Writes the report as json or markdown; other kinds are an error."""
    kind = (kind or "").strip().lower()
    if kind not in FORMATS:
        raise ValueError(f"a report is written as {' or '.join(FORMATS)}, not {kind!r}")
    body = markdown(report) if kind == "markdown" else json.dumps(report, ensure_ascii=False, indent=2) + "\n"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body)
    return path
