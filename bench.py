"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tapewell.plans import catalog
from tapewell.session import build_session, job

HEADLINE = (
    "a35_backtest_summary", "w02_log_returns", "w09_xsec_rank", "w13_pair_correlation", "u05_complete_panel", "w15_vendor_priority",
    "a04_reconciliation_metrics", "w26_price_outliers", "p01_validate_records", "j02_asof_fundamentals", "a02_interest_concentration",
    "w22_interest_change", "p08_surface_normalize", "w25_insider_intensity", "t04_rollout", "a09_performance", "a10_trading", "a29_regime_slices",
    "t05_order_compilation", "t06_risk_checks", "t08_fill_simulation", "a21_execution_quality", "t14_regression_gates", "k01_bar_upsert",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        t0 = time.perf_counter()
        with job(spark):
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
