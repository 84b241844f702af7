"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds for each query."""

from __future__ import annotations

import json
import os
import time

from rootspan.plans import catalogue
from rootspan.session import local_session

HEADLINE = ["start_reach", "start_count_per_vertex", "weight_in", "weight_norm", "class_mean_weight", "merge_groups", "placement_stats", "snapshot_after", "starts_after_insert"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")))
    catalogue.QUERIES["vertex_role_and"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
