"""Connected components of an edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import discard, join_per_key, materialize

from .local import labels

#: Up to so many edges one task ends the job.
ONE_TASK_EDGES = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b). Large: a node's larger neighbours move to its least one; small: its smaller ones and itself do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = materialize(least.withColumn("m", F.least("a", "m")), "least")
    moved = join_per_key(both, least, ["a"], "n", both.count(), ["b"])
    moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, least = labels(pdf.a.to_numpy(), pdf.b.to_numpy())
    return pd.DataFrame({"a": ids, "b": least}).query("a != b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """id and component (the smallest id that edges lead to) of every node that has an edge. Loops and nulls don't count.

    Large and small stars alternate until every edge points to the root of its component, in a number of rounds that is
    logarithmic in practice; a round moves each edge twice and nothing is collected. Before, edges that close a cycle within
    a share of one_task edges go, as long as that drops a tenth of them; up to one_task edges go to one task.
    """
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    current = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull()).where("a > b").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    turn, drops = 0, True
    while drops and (count := current.count()) > one_task:
        share = F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.lit(-(-count // one_task)))
        thin = materialize(current.groupBy(share.alias("_g")).applyInPandas(_labelled, "a bigint, b bigint").distinct(), "thin")
        turn, drops = turn + 1, thin.count() < 0.9 * count
        discard(current)
        current = thin
    before = state(current)
    if 0 < before[0] <= one_task:
        current, before = materialize(current.groupBy(F.lit("all").alias("_g")).applyInPandas(_labelled, "a bigint, b bigint"), "small"), (0, None)
    while before[0]:
        large = materialize(_star(current, True), "large")
        after = materialize(_star(large, False), "small")
        now = state(after)
        discard(current, large)
        current = after
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
