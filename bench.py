"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Per query one warm-up and up to five timed runs (fewer once a query has used its time), the
mean is reported.  A run builds the plan and computes every row and column.

The given tables are one row group each, which only one task can read.  They are first copied, all rows
and columns, into the scratch folder with as many files as cores, as a table on a cluster has; the timed
runs read these copies.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ans1_extract_answer", "ans3_last_number", "nrm1_normalize_answer", "grd3_numeric",
    "grd6_tuples", "trj3_merge_programs", "agg1_accuracy", "agg2_position_curve",
    "agg3_type_accuracy", "agg5_maj_at_8", "agg7_rm_at_4", "agg8_bool_majority",
    "jn1_resume_anti", "jn3_transitions", "win1_last_record", "agg13_stats_by_each",
    "agg14_pivot_two_keys", "agg18_five_numbers", "agg10_question_nll", "agg11_perplexity",
    "agg21_cost_rollup", "eval_wide_samples", "win3_cost_curve", "arr2_fake_quantize", "win4_prefix_sum",
    "smp4_sample_windows", "smp8_consecutive_windows", "sft1_chat_records", "adp6_typed_numbers", "pmt3_few_shot",
]


def main() -> None:
    from markbook.plans import QUERIES
    from markbook.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    budget = float(os.environ.get("BENCH_QUERY_SECONDS", "6"))
    shared = tempfile.mkdtemp(prefix="bench-")
    parts = max(8, int(cores) if cores.isdigit() else 8)
    spark = build_session("bench", cores, shuffle_partitions=parts, shared=f"file://{shared}")
    spark.sparkContext.setLogLevel("ERROR")

    laid_out = f"file://{shared}/tables"
    for table in sorted(x for x in os.listdir(folder) if x.endswith(".parquet")):
        spark.read.parquet(f"{folder}/{table}").repartition(parts).write.parquet(f"{laid_out}/{table}")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        times: list[float] = []
        while len(times) < 5 and (not times or sum(times) + times[-1] < budget):
            times.append(run(name))
        seconds[name] = round(sum(times) / len(times), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
