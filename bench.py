"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog
from tidemark.session import build_session

HEADLINE = [
    "asof_region_revisions", "asof_grid", "truth_all_levels", "first_release", "training_leakage", "change_components", "revision_audit",
    "panel_features", "seasonal_naive_backtest", "score_summary", "pooled_conformal_widths", "calibrated_forecasts", "two_way_bootstrap",
    "reconciled_forecasts", "reconstruction_validation", "canonical_codes", "table_hashes",
    "rolling_ets", "rolling_stl_arima",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
