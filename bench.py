"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fillwatch.operators import em
from fillwatch.plans import QUERIES
from fillwatch.plans.views import Tables
from fillwatch.session import get_spark

HEADLINE = ["flt1_clean_trades", "win1_features", "win1_features_big", "wal2_size_scores", "wal4_vpin", "wal8_wash_scores",
            "wal10_prefilter", "top2_wallet_ranking", "evl1_roc_auc", "evl4_kendall", "evt2_window_stats", "evt4_market_results",
            "bkt2_positions", "bkt10_fold_report", "cas1_wallet_table", "agg11_credible_interval", "cal14_rank_truth",
            "cal10_coverage", "sco1_filter_scores", "sco5_online_scores"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                                    "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flt1_clean_events"](spark, sf_dir).collect()  # start the JVM's and Python's workers outside the clock
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    features = Tables(spark, sf_dir).stored_features
    n = features.count()
    t0 = time.perf_counter()
    fit = em.fit_em(features, n_iter=10, tol=0.0)
    times["fit1_em_10_iterations"] = round(time.perf_counter() - t0, 3)
    rate = n * len(fit.trace) / times["fit1_em_10_iterations"]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rsplit("sf", 1)[-1], "em_trade_steps_per_sec": round(rate)}))


if __name__ == "__main__":
    main()
