"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Timed steps (seconds, wall clock, each fully materialised):
  book_build      fixture book from orders x customer: features, rating plan, outcomes,
                  capped losses, scores (the "score a book" step of the baseline)
  <report>        portfolio reports served from the cached book
  train_all       GLMs + Tweedie IRLS + O/E study + M-hat ensemble with OOF stacking +
                  display models + test-split anchors
  score_book_ml   every output column of the model chain for the whole book
Large outputs are materialised with the ``noop`` sink (all columns computed, nothing
collected); small ones are collected.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("riskbook-bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.eventLog.enabled", "false")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskbook-bench-"))

    from riskbook import catalog, catalog_ml  # noqa: F401
    from riskbook.session import ensure_checkpoint_dir, lease, shared_bytes
    q = catalog.QUERIES
    times: dict = {}

    def run(name, fn, big=False):
        t0 = time.time()
        with lease(spark):  # the report's scratch folders go when it has been read
            df = fn()
            if big:
                df.write.format("noop").mode("overwrite").save()
            else:
                df.collect()
        times[name] = round(time.time() - t0, 3)

    t0 = time.time()
    bk = catalog.book(spark, sf_dir)
    n = bk.count()
    times["book_build"] = round(time.time() - t0, 3)

    small = ["portfolio_kpis", "loss_ratio_by_band", "band_distribution", "state_summary", "state_peril_matrix",
             "correlation_matrix", "column_summary", "group_oe", "m_distribution", "reclassification",
             "generation_report", "peril_severity", "roi_grid", "drift_psi", "gini", "gini_oracle",
             "decile_loss_ratio", "decile_lift", "interaction_contribution", "kendall_tau_b"]
    big = ["active_interactions", "reason_codes", "premium_attribution", "risk_narrative", "scenario_cross",
           "whatif_delta", "score_a1_percentile"]
    for k in small:
        run(k, lambda k=k: q[k](spark, sf_dir))
    for k in big:
        run(k, lambda k=k: q[k](spark, sf_dir), big=True)

    t0 = time.time()
    with lease(spark):
        catalog_ml.bundle(spark, sf_dir)
    times["train_all"] = round(time.time() - t0, 3)
    t0 = time.time()
    from riskbook.ml.score import score_book
    score_book(bk, catalog_ml.bundle(spark, sf_dir)).write.format("noop").mode("overwrite").save()
    times["score_book_ml"] = round(time.time() - t0, 3)

    catalog.release_books(spark)
    left = shared_bytes(spark, ensure_checkpoint_dir(spark))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "policies": n, "cpus": int(cpus), "scratch_bytes_left": left}))
    spark.stop()


if __name__ == "__main__":
    main()
