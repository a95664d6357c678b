"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], *filter(None, [os.environ.get("PYTHONPATH")])])

from sylvan.plans.graph_queries import QUERIES  # noqa: E402

HEADLINE = (
    "star_nation_dendrogram", "hook_customer_dendrogram", "geo_tree_dendrogram", "event_cartesian", "trade_msf", "trade_dendrogram", "embedding_msf", "embedding_dendrogram",
    "copart_triangles", "copart_support", "copart_triangle_weights", "copart_truss", "copart_similarity_dendrogram", "deg_weights", "graph_offsets",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # the session's own start isn't a query's
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()
