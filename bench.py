"""Times headline queries and prints one JSON line. Every query is run whole, into a sink that drops rows."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "agg02_weekly_panel", "win09_liquid_universe", "agg03_settled_events", "jn01_asof_observations", "agg08_daily_dispersion",
    "win06_daily_features", "sig02_weekly_regressions", "sig08_cross_sectional_forecasts", "pnl10_bucket_portfolios",
    "scr06_series_score", "scr07_bootstrap_paths", "scr17_combinatorial_splits", "scr21_split_stress",
    "pnl03_carry_trades", "scr12_headline_score", "pnl06_option_trades", "win07_realized_variance",
    "pnl11_long_or_cash", "pnl12_sector_rotation", "pnl17_managed_series", "sig11_factor_regression", "pnl13_weekly_results",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelcraft.plans import catalog

    chosen = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/region.parquet").count()  # session start is not a query
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    label = Path(sf).name
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(label[2:]) if label.startswith("sf") else label,
    }))


if __name__ == "__main__":
    main()
