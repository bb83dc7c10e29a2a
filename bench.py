"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is computed whole into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from folioscope.workload.queries import queries

HEADLINE = (
    "s3_violations", "s14_invoice_fields", "v1_money_network", "v2_invoices_against_bank",
    "t2_t3_thresholds", "g1_money_cycles", "i5_nearest_known", "i6_screening",
    "m3_concept_verdicts", "d1_bought_from_listed", "d2_unmatched_payments",
    "d4_vague_concepts", "d5_undeclared_income", "d6_candidates", "e1_resolved_evidence",
    "e3_verdicts", "p1_batch_verdicts", "r5_trail_text", "a3_denied_cases",
    "a4_wrong_list_status", "a5_swapped_amounts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known, times, errors = queries(), {}, {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        try:
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one broken query must not hide the others' times
            errors[name] = f"{type(error).__name__}: {str(error)[:300]}"
            print(f"{name} {errors[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "unit": "sec",
        "value": round(sum(times.values()), 3), "queries": times,
        "sf": sf_dir.rsplit("/", 1)[-1].removeprefix("sf"), "errors": errors}))
    if errors:
        sys.exit(1)


if __name__ == "__main__":
    main()
