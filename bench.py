"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from quarry.session import get_session

HEADLINE = ("token_estimate_by_lang", "importers_of_symbol", "fan_in", "impact_risk", "find_bm25", "find_reranked", "staleness_report", "upsert_files", "gain_by_project", "gain_daily", "first_edit_sessions", "callers_grouped")


def main() -> None:
    from quarry.plans.catalogue import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # compiled and read once
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
