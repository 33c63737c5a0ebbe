"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from velum.plans.registry import QUERIES  # noqa: E402
from velum.session import build_session  # noqa: E402

HEADLINE = [
    "detect_entities", "dedupe_spans", "assign_tokens", "mask_documents", "restore_text", "leak_check",
    "label_columns", "fuzzy_label_columns", "kb_upsert", "profile_columns", "scan_columns", "mask_customers",
    "explode_json", "explode_sql_literals", "mask_payloads", "mask_conversations", "audit_rows",
    "event_bursts", "ner_examples",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    texts = spark.read.parquet(f"{root}/documents.parquet").count()
    rates = {}
    if "mask_documents" in seconds:
        rates["texts_masked_per_sec"] = round(texts / seconds["mask_documents"], 1)
    if "profile_columns" in seconds:
        rates["columns_profiled_per_sec"] = round(25 / seconds["profile_columns"], 2)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(root.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
