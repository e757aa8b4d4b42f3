"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables and BENCH_CPUS the cores. Each query runs once to
warm up and is then timed; results are written to a no-op sink in full. ``build_sec`` is
the part of a query's time that goes by before Spark starts on the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldscan.session import build_session
from workload.queries import QUERIES

HEADLINE = [
    "flatten_customers",
    "flatten_nested_orders",
    "name_classify_vocabulary",
    "pattern_spans_documents",
    "classify_fields_documents",
    "classify_fields_pages",
    "classify_fields_customers",
    "message_tags",
    "audit_rows",
    "field_profile",
    "alerts",
    "gazetteer_entities",
    "interval_scan",
    "scan_results",
    "latest_batch_best",
    "upsert_recommendations",
    "submit_staged",
    "apply_tags",
]
MESSAGES = {
    "classify_fields_documents": "documents",
    "classify_fields_pages": "pages",
    "classify_fields_customers": "customer",
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="bench", **{"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    times, builds, rates = {}, {}, {}
    for name in names:
        for _ in range(2):
            start = time.time()
            df = QUERIES[name](spark, sf)
            builds[name] = round(time.time() - start, 3)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        if name in MESSAGES:
            n = spark.read.parquet(f"{sf}/{MESSAGES[name]}.parquet").count()
            rates[name] = round(n / times[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build_sec": builds, "messages_per_sec": rates, "sf": sf, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
