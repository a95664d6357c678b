"""Edge tables: canonical form, numbering, degrees, orientation and checks.

A graph is a table (src, dst[, w]) with one row per undirected edge, src < dst; vertices are any longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.runtime import materialize

#: Up to so many rows one task numbers them all.
ONE_TASK_ROWS = 1 << 20


def canonical_edges(edges: DataFrame, loops: str = "drop") -> DataFrame:
    """One row (src < dst, w) per undirected edge; of parallel edges the least weight stays. Weights of -0.0 become 0.0.
    A column pos (position in the input) stays too, other columns go.

    loops: 'drop' self-loops or 'error' on them. A null or NaN weight or a null endpoint is an error.
    """
    weighted = "w" in edges.columns
    bad = F.col("src").isNull() | F.col("dst").isNull()
    if loops == "error":
        bad = bad | (F.col("src") == F.col("dst"))
    if weighted:
        bad = bad | F.col("w").isNull()
        if dict(edges.dtypes)["w"] in ("float", "double"):
            bad = bad | F.isnan("w")
            edges = edges.withColumn("w", F.col("w") + F.lit(0.0).cast(dict(edges.dtypes)["w"]))
    checked = edges.where(F.when(bad, F.raise_error(F.lit("an edge has a null endpoint, a null or NaN weight, or is a loop where none is allowed")).cast("boolean")).otherwise(F.col("src") != F.col("dst")))
    kept = [c for c in ("w", "pos") if c in edges.columns]
    pair = checked.select(F.least("src", "dst").cast("bigint").alias("src"), F.greatest("src", "dst").cast("bigint").alias("dst"), *kept)
    return pair.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in kept]) if kept else pair.distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    """Two rows per edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def dense_index(rows: DataFrame, order: list, name: str, total: int | None = None) -> DataFrame:
    """rows with their place (from 0) in the order of these columns. Larger tables are range-partitioned, and each range numbered from an offset."""
    total = rows.count() if total is None else total
    if total <= ONE_TASK_ROWS:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    ranged = materialize(rows.repartitionByRange(max(2, total // ONE_TASK_ROWS + 1), *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    placed = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_from") + F.col("_r") - 1).drop("_p", "_r", "_from")


def next_in_group(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the `value` of the next row of their group in this order (none: null), however large a group is.

    rows are range-partitioned by (group, order), so a group may span ranges. Inside a range a window finds the next row; the
    last row of a range continues in the first row of the next one, which one row per range tells.
    """
    keys = [*group, *order]
    ranged = materialize(rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("_p").agg(F.min(F.struct(*keys, F.col(value).alias("_v"))).alias("first"), F.max(F.struct(*keys)).alias("last"))
    ends = ends.select("_p", "last", F.lead("first").over(Window.orderBy("_p")).alias("following"))  # one row a range
    goes_on = F.lit(True)
    for c in group:
        goes_on = goes_on & F.col(f"last.{c}").eqNullSafe(F.col(f"following.{c}"))
    ends = ends.where(goes_on).select("_p", F.col("last").alias("_last"), F.col("following._v").alias("_beyond"))
    own = F.lead(value).over(Window.partitionBy("_p", *group).orderBy(*order))
    found = ranged.withColumn(name, own).join(F.broadcast(ends), "_p", "left")
    beyond = F.when(F.struct(*keys) == F.col("_last"), F.col("_beyond"))
    return found.withColumn(name, F.coalesce(name, beyond)).drop("_p", "_last", "_beyond")


def edge_index(edges: DataFrame) -> DataFrame:
    """edges with e: the rank of (src, dst), from 0."""
    return dense_index(edges, ["src", "dst"], "e")


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree of every vertex with an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def offsets(edges: DataFrame) -> DataFrame:
    """id, degree and the exclusive prefix sum of degrees in order of id, as an adjacency file has them."""
    deg = dense_index(degrees(edges), ["id"], "place")
    bucket = F.floor(F.col("place") / ONE_TASK_ROWS)
    base = deg.groupBy(bucket.alias("_b")).agg(F.sum("degree").alias("s")).select("_b", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inner = F.coalesce(F.sum("degree").over(Window.partitionBy("_b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return deg.withColumn("_b", bucket).join(base, "_b").select("id", "degree", (F.col("_from") + inner).alias("offset"))


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge from its end of lower (degree, id) to the other: lo, hi. Out-degrees then are at most about sqrt(2 m)."""
    deg = degrees(edges)
    both = edges.select("src", "dst").join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    low = F.struct("ds", "src") < F.struct("dd", "dst")
    return both.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("hi"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def is_forest(edges: DataFrame) -> bool:
    """Whether canonical edges have no cycle: vertices less components are as many as edges."""
    from .components import connected_components

    parts = connected_components(edges)
    n, c = parts.agg(F.count("*"), F.count_distinct("component")).first()
    return edges.count() == n - c
