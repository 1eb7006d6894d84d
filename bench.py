"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The domain tables are first written at rest (Parquet, sorted for pruning)
from the driver tables; that step is timed as ``load_domain_tables``. Each
query then runs against the at-rest tables and is forced end to end with the
``noop`` sink (full execution, nothing collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terminus.catalog import QUERIES  # noqa: E402
from terminus.session import build_session  # noqa: E402
from terminus.sources.tables import CATALOG_PREFIX, materialize, materialize_bucketed  # noqa: E402

HEADLINE = ["revenue_report", "active_bookings", "driver_stats", "admit_bookings",
            "stream_daily_revenue", "trip_statistics", "driver_earnings", "queue_status",
            "latest_payment", "trip_manifest", "advance_queue", "seat_ledger_running",
            "admit_smart_bookings", "integrity_audit"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    layout = os.environ.get("BENCH_LAYOUT", "bucketed")
    scratch = tempfile.mkdtemp(prefix="terminus-bench-", dir="/tmp")
    extra = {"spark.sql.files.maxPartitionBytes": str(64 << 20),
             "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse")}
    if os.environ.get("BENCH_EVENTLOG") == "1":
        # Stage and task times for later study, kept in the scratch folder.
        os.makedirs(os.path.join(scratch, "events"), exist_ok=True)
        extra.update({"spark.eventLog.enabled": "true",
                      "spark.eventLog.dir": "file://" + os.path.join(scratch, "events")})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8), extra=extra)
    t0 = time.time()
    if layout == "bucketed":
        materialize_bucketed(spark, sf_dir, "terminus_bench", max(cpus * 2, 8))
        at_rest = CATALOG_PREFIX + "terminus_bench"
    else:
        at_rest = os.path.join(scratch, "tables")
        materialize(spark, sf_dir, at_rest)
    timings = {"load_domain_tables": round(time.time() - t0, 3)}
    for n in names:
        best = None
        for _ in range(repeats):
            t1 = time.time()
            QUERIES[n](spark, at_rest).write.format("noop").mode("overwrite").save()
            dt_ = time.time() - t1
            best = dt_ if best is None else min(best, dt_)
        timings[n] = round(best, 3)
    total = round(sum(v for k, v in timings.items() if k != "load_domain_tables"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "repeats": repeats, "layout": layout}))
    spark.stop()


if __name__ == "__main__":
    main()
