"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliant.catalog import all_queries  # noqa: E402
from foliant.session import build_session  # noqa: E402

HEADLINE = """chunk_passages hash_vectors postings_stats bm25_topk dense_topk hybrid_search passage_search redact_secrets redact_pii
flag_suspicious screen_input page_intake clean_history latest_by_name library_as_of removed_documents admit_within_quota rate_limit
rate_limit_stream""".split()
#: Timed too, but not part of the total, which stays comparable: the stored index (built and searched, and brought up to date), the flow, intake, one hot key,
#: and as a control a query whose code has not changed since the first measurement.
MORE = "indexed_search rebuild_stale answer_batch ingest_stream lockout_one_key library_at_question visible_rows".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["tokenized_documents"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE + MORE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
