"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1
for every registered query. Each query is timed once, writing to the no-op sink, so the whole
result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "b1_pages_to_text", "b5_split_sections", "b9_posting_key", "b13_fingerprint", "c2_recall", "c4_label_hits", "c5_keep_last", "d1_top_terms", "d2_dictionary_hits", "d5_score_terms", "d7_tech_terms",
    "d3_phrase_hits", "d11_hard_skills", "e1_coverage", "e8_title_signal", "e10_match_quals", "e14_archetypes", "f4_metrics", "f9_prose_score", "g3_tenure", "h6_canonical_location", "i10_send_policy", "j2_activity", "j4_sessions_batch", "j6_latest_state", "j7_limit_stream", "j9_stream_recall",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from postlens.functions.session import SPREAD, build_session
    from postlens.plans import all_queries

    spark = build_session(f"local[{cpus}]", cpus)
    spark.conf.set(SPREAD, "true")  # the tables are files of one row group each
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("max(length(text))").collect()  # JVM start-up is not a query
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
