"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores).
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentrank.plans.queries import all_queries  # noqa: E402
from sentrank.session import build_session  # noqa: E402

HEADLINE = [
    "topk_formula_score", "formula_score", "topp_slice", "topp_per_day", "features_full", "features_blake2b",
    "recency_per_agent", "fit_recency_median", "canonicalise", "dedup_keep_first", "temporal_split",
    "coverage_report", "uniform_sample", "corpus_summary", "hour_weekday_matrix", "inject_replace", "metrics_at_p",
    "metrics_per_day", "drift_by_day", "knn_score", "lof_score", "iforest_score", "sweep_best_k",
    "occlusion_topn", "reason_codes_neighbor", "reason_summary", "stream_recency", "stream_enrich_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = build_session(
        "sentrank-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    queries["hour_hist"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # start the JVM paths
    seconds = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
