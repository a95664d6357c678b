"""Trees by formula, as edge tables (src, dst, w, pos) with unit weights and each edge's position; nothing is read and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _edges(rows: DataFrame, src, dst, pos=None) -> DataFrame:
    return rows.select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(1).cast("bigint").alias("w"), (F.col("id") if pos is None else pos).cast("bigint").alias("pos"))


def path(spark: SparkSession, n: int = 10) -> DataFrame:
    """n vertices in a row."""
    return _edges(spark.range(max(0, n - 1)), F.col("id"), F.col("id") + 1)


def star(spark: SparkSession, n: int = 10) -> DataFrame:
    """Vertex 0 with n - 1 leaves."""
    return _edges(spark.range(1, max(1, n)), F.lit(0), F.col("id"), F.col("id") - 1)


def caterpillar(spark: SparkSession, k: int = 3) -> DataFrame:
    """2^k vertices: a spine over the lower half, a leg on each of its vertices."""
    m = (1 << k) - 1
    return _edges(spark.range(m), F.when(F.col("id") < m // 2, F.col("id")).otherwise(F.col("id") - m // 2), F.col("id") + 1)


def full_binary(spark: SparkSession, k: int = 3) -> DataFrame:
    """The complete binary tree of 2^k - 1 vertices, numbered by levels."""
    rows = spark.range(1 << (k - 1) if k > 1 else 0).where(F.col("id") < ((1 << k) - 1) // 2)
    return _edges(rows.select("id", F.explode(F.array(2 * F.col("id") + 1, 2 * F.col("id") + 2)).alias("child")), F.col("id"), F.col("child"), F.col("child") - 1)


#: Draws of uniform_hook: two steps of multiplicative congruential generators give 62 bits, in arithmetic that any SQL has.
MODULUS, FIRST, SECOND, SEED = (1 << 31) - 1, 48_271, 69_621, 16_807


def uniform_hook(spark: SparkSession, n: int = 10, seed: int = 0) -> DataFrame:
    """Vertex i hangs on a vertex below it: the remainder by i of a number drawn from i and the seed by a formula."""
    one = (F.col("id") % MODULUS * FIRST + (seed + 1) * SEED) % MODULUS
    draw = one * (1 << 31) + (one * SECOND + 1) % MODULUS
    return _edges(spark.range(1, max(1, n)), F.col("id"), draw % F.col("id"), F.col("id") - 1)


def zipf_hook(spark: SparkSession, n: int = 10, exponent: float = 1.5, seed: int = 0) -> DataFrame:
    """An extension: like uniform_hook, but low vertices are preferred by a power law."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return _edges(spark.range(1, max(1, n)), F.col("id"), F.least(F.floor(F.col("id") * F.pow(u, F.lit(exponent))), F.col("id") - 1), F.col("id") - 1)


GENERATORS = {"path": path, "star": star, "caterpillar": caterpillar, "full_binary": full_binary, "uniform_hook": uniform_hook, "zipf_hook": zipf_hook}
