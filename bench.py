"""Seconds per headline query; one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names
separated by commas, ``all`` for every query), BENCH_RUNS (default 1; the median counts)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom.plans.queries import QUERIES  # noqa: E402
from spanloom.session import build_session  # noqa: E402

HEADLINE = [
    "iob_to_spans",
    "tree_to_spans",
    "tree_unary_collapse",
    "entity_vocab",
    "global_ids",
    "negative_spans",
    "default_negatives",
    "cached_candidates",
    "filter_flat",
    "cluster_set",
    "clusters_to_tokens",
    "source_comparison",
    "assign_types",
    "flat_select",
    "span_tree",
    "confusion_pairs",
    "perfect_sentences",
    "prf_report",
    "inference_report",
    "training_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.spanloom.spreadScans": cpus,  # the test tables have one row group each
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("flat_select")  # start the JVM's compiler and the Python workers
    seconds = {n: round(statistics.median(run(n) for _ in range(runs)), 3) for n in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
