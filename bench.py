"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query derives its
input from the files again: nothing is cached between queries. A small query warms
the JVM up first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayline.checks.queries import all_queries  # noqa: E402
from stayline.session import build_session  # noqa: E402

HEADLINE = (
    "retention_report", "score_retention", "score_bulk", "kpi_dashboard", "kpi_retention",
    "churn_rate_by_location", "clv_by_segment", "revenue_at_risk_by_segment", "cluster_profile",
    "segment_map", "crosstab_category", "correlation_pairs", "describe_numeric",
    "histogram_by_class", "encode_categories", "scale_churn", "split_stratified", "roc_auc",
    "roc_curve", "classification_report", "clv_metrics", "offers_full", "offers_short",
    "sensitivity", "best_action", "action_summary", "intervention_impact", "customer_report",
    "train_gbt", "train_kmeans",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("count_by_label")
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
