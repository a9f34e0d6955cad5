"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ("scan_hash", "change_set", "doc_lines", "keywords_vector", "vector_topk", "vector_boost_threshold", "rrf_fusion", "lexical_topk", "text_vector_topk", "hybrid_topk", "golden_summary", "context_build", "plan_steps", "key_files")


def main() -> None:
    from skein.plans import reference
    from skein.session import session

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()  # the first job starts the engine
    times = {}
    for name in NAMES:
        began = time.time()
        reference.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    n = spark.read.parquet(f"{d}/benchmark.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "lexical_ms_per_question": round(1000 * times["lexical_topk"] / max(1, n), 2), "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
