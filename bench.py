"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each runs once to warm up, then counts."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ("q_jn05_replica_merge", "q_sk01_ingest", "q_sc01_get_data", "q_sc02_scan_shards", "q_wn11_deviations", "q_wn14_thinning", "q_cd02_round_trip", "q_st15_log_gaps")


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tidewell.plans import registry

    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            registry.queries()[name](spark, where).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
