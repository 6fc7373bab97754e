"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_QUERIES  comma-separated names, or ``all``
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HEADLINE = [
    "h2h_records", "batting_career", "bowling_career", "venue_stats", "team_form", "season_summary", "match_features",
    "innings_progress", "bowler_last3", "batter_form", "intent_features", "intent_features_prior", "player_docs",
    "doc_corpus", "bm25_topk", "dense_topk", "hybrid_retrieve", "matchup_context", "audit_report", "latency_summary",
    "upsert_career_stats", "intent_model", "stream_matchup", "ingest_deliveries", "store_reload",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from innings.plans.registry import entries
    from innings.session import local_session

    spark = local_session(cpus, "innings-bench", int(cpus))
    known = entries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(known) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    # Start the JVM, the Python workers and the file listing before the first timing.
    known["h2h_records"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
