"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1) and BENCH_CPUS the local cores. Every query is planned
and run to the end over whole tables; results go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "macro_assemble", "macro_attribution", "macro_summary", "align_rows", "detection_grading", "top_features",
    "reputation_flags", "alert_sessions", "alert_transitions", "alert_occurrence_counter", "alert_top_attackers",
    "outbox_messages", "activity_counts", "rolling_rate", "log_counts", "text_search", "metric_throughput",
    "classification_report", "accuracy_mcc", "roc_auc", "constant_columns", "training_clean_pipeline",
    "standard_scaling", "stratified_split", "csv_audit", "csv_audit_macro", "packet_flows", "stream_alerts",
    "stream_alert_transitions", "registered_model_evaluation",
)


def main() -> None:
    from flowtide import catalog
    from flowtide.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    known = catalog.queries()
    # Start-up work (class loading, first code generation) is not a query's cost.
    known["severity_bands"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
