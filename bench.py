"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print
one JSON line. Each query is executed in full with a no-op sink (nothing is collected to
the driver); the reported time is the median of $BENCH_REPS runs (default 3) after a
warm-up of the JVM on the first queries. Texts are dealt over BENCH_SPREAD partitions (twice
the cores by default); scratch tables go after each query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from credline.plans.queries import QUERIES  # noqa: E402
from credline.session import build_session, clean_scratch  # noqa: E402

# every registered query, in registry order
HEADLINE = list(QUERIES)


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    # the bench tables are one row group each: deal texts over the cores (see plans/views.py)
    spark.conf.set("credline.spread", os.environ.get("BENCH_SPREAD", str(int(cpus) * 2)))
    for n in names[:5]:  # warm-up: JVM JIT, file listing caches
        run_once(spark, n, sf_dir)
    per = {}
    for n in names:
        clean_scratch(spark)
        per[n] = round(statistics.median(run_once(spark, n, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_medians", "value": round(sum(per.values()), 3),
                      "unit": "sec", "queries": per, "sf": sf, "cpus": int(cpus), "reps": reps}))


if __name__ == "__main__":
    main()
