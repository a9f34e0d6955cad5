"""Golden queries from a YAML list."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query_id string, question string, expected_files array<string>, expected_symbols array<string>, category string, difficulty string, mode string, description string"


def load(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, list):
        raise ValueError("a golden dataset is a list of queries")
    rows = []
    for i, x in enumerate(raw, 1):
        if not isinstance(x, dict) or not str(x.get("question") or "").strip():
            raise ValueError(f"query {i} has no question")
        texts = lambda k, x=x: [str(v) for v in ([x[k]] if isinstance(x.get(k), str) else x.get(k) or [])]
        question = str(x["question"]).strip()
        rows.append((str(x.get("id") or question or f"q{i}"), question, texts("expected_files"), texts("expected_symbols"), *[x.get(k) and str(x[k]) for k in ("category", "difficulty", "mode", "description")]))
    return spark.createDataFrame(rows, SCHEMA)
