"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from textwarden.plans.queries import QUERIES
from textwarden.session import build_session

HEADLINES = (
    "pii_corpus_mask", "pii_entity_rollup", "pii_sdk_mask", "prompt_injection_scan", "jailbreak_scan", "cross_turn_injection",
    "guard_decision", "deobfuscated_scan", "request_threat_scan", "surface_breakdown", "canary_leaks", "route_match",
    "identity_join", "client_addresses", "audit_build", "audit_verify", "soc_counters", "threat_breakdown", "latency_avg",
    "recent_events", "detector_scores", "stream_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "textwarden-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    seconds = {}
    for name in wanted:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
