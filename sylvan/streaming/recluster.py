"""An extension: dendrograms over a stream of edges.

A forest of all edges so far holds what later dendrograms need, so each micro-batch joins its edges to the stored forest,
reduces them to the new one, and stores this with the dendrogram under the batch's number. A batch that runs again writes
the same folders again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sylvan.operators.dendrogram import dendrogram
from sylvan.operators.graph import canonical_edges
from sylvan.operators.msf import minimum_spanning_forest


def _latest(spark: SparkSession, path: str, before: int) -> int | None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/forest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((x for x in done if x < before), default=None)


def recluster(edges: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that keeps path/forest/N and path/dendrogram/N up to date with a streaming edge table (src, dst, w)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _latest(spark, path, number)
        known = batch.select("src", "dst", "w")
        if last is not None:
            known = known.unionByName(spark.read.parquet(f"{path}/forest/{last}"))
        minimum_spanning_forest(canonical_edges(known)).write.mode("overwrite").parquet(f"{path}/forest/{number}")
        dendrogram(spark.read.parquet(f"{path}/forest/{number}")).write.mode("overwrite").parquet(f"{path}/dendrogram/{number}")

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
