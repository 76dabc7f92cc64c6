"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs in full; its result is written to the ``noop`` sink, so that all rows and columns are
computed and none are brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from laneguard.plans.catalog import QUERIES, bind  # noqa: E402
from laneguard.session import build_session  # noqa: E402

HEADLINE = (
    "a05_parse_exports", "a06_ingest_merge", "b04_clean_html", "b24_search_events", "b31_reply_records", "b36_keyword_extract",
    "c06_link_cascade", "c10_exposed_lanes", "c11_pit_history", "c20_integrity", "d01_lane_exposure", "d05_extraction_prf",
    "d08_replay_v1", "d09_replay_v2", "d10_lead_time", "d11_false_alarms", "d13_model_metrics", "d14_medians", "e01_dedupe",
    "i02_lane_routes", "i03_alternate_routes", "j04_logistic", "k02_mitigations", "k04_ground_brief",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="laneguard-bench", shuffle_partitions=cpus, driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # JVM and reader start-up are not part of any query
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        bind(QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
