"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "batch_aggregate", "daily_summary", "supervised_windows", "fc_sweep", "fc_lag_regression",
    "ev_rank_topn", "cause_rank", "pt_global", "pt_local", "osm_aggregate",
    "kg_edges", "kg_node_values", "kg_conflict_pairs", "kg_relationships", "kg_embed_align", "kg_directional_check",
    "tx_sections", "tx_normalize", "au_result_line", "cl_atomic_claims", "jd_arm_summary", "st_bootstrap_ci",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from kpiscope.plans import catalogue
    from kpiscope.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["split_holdout"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
