"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one warm-up, then the median of three timed runs each.

Prints one JSON line. Rows are counted through a no-op sink, so every column is computed and nothing is brought to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from litprops.session import local_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "article_baseline",
    "range_hit_rate_and_nars",
    "article_losses",
    "validation_errors",
    "parsed_responses",
    "markdown_titles",
    "add_titles",
    "ragged_offsets",
    "article_numbers",
    "exact_duplicates_dropped",
    "property_report",
    "prompt_types",
    "ratio_vectors",
    "mean_pooling",
    "attention_pooling",
    "hybrid_inputs",
    "line_graph_edges",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
