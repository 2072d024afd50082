"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma separated, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import suite  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "asof_ttl asof_created asof_multi_view asof_global asof_hot_keys asof_part_price asof_alias entityless_all "
    "latest_per_user latest_order lookup_status upsert_newer agg_lineitem tumbling_day sliding_day sliding_tiled "
    "impute_and_scale clean_first_orders training_rows ratios encode_labels dq_suite dq_profile dq_column_stats "
    "chunks embedded_documents vector_topk_cosine vector_topk_l2 bm25_any bm25_all match_all_terms "
    "lineage_edges lineage_trace_all model_metrics stream_latest stream_tumbling stream_tiled "
    "historical_aggregate_view sliding_tiled_latest on_demand_pandas ivf_topk lineage_trace stream_after_materialize "
    "sliding_sparse asof_stored lookup_buckets"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    suite.load_all()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    names = list(suite.QUERIES) if names == ["all"] else names
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            suite.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt or not runs:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    line = {
        "metric": "headline queries, sum of median seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
