"""Session helpers shared by every operator: durable intermediates and joins that survive hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of the rows; so at most HOT_SHARE keys are hot, and they may be broadcast.
HOT_SHARE = 256
#: Below this many rows no key is worth a salt.
HOT_LEAST = 1000
#: Partitions over which a hot key is spread.
HOT_FAN = 64


#: Applications whose workers have been given this package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers that wouldn't find it: unless its folder is on PYTHONPATH, or local workers start in it."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    on_path = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    at_home = context.master.startswith("local") and "cluster" not in context.master and Path.cwd() == root
    if on_path or at_home or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="sylvan-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/sylvan", "zip", root, "sylvan"))
    _shipped.add(context.applicationId)


#: Folders of our own, for sessions without a shared one.
_own: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="sylvan-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = f"file://{folder}"
        path = _own[app]
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/sylvan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # for discard()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialized DataFrames that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        stored = getattr(df, "stored_at", None)
        if isinstance(stored, str):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(stored)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def gathered(parts: list[DataFrame]) -> DataFrame:
    """All rows of materialized tables of one schema, read by one scan. Loops keep their results in parts, each written once."""
    spark = parts[0].sparkSession
    return spark.read.schema(parts[0].schema).parquet(*[p.stored_at for p in parts])


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """Join rows with one row per key, spreading hot keys over HOT_FAN partitions.

    per_key is unique in keys (none null); its column count says how many rows carry the key (or an upper bound of the
    same order); total is their sum. At most HOT_SHARE keys can hold over total / HOT_SHARE rows, so only these are
    broadcast, to mark the rows to salt by a hash of the columns spread. per_key is read twice: materialize it.
    """
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = per_key.where(F.col(count) > least).select(*keys, F.lit(True).alias("_hot"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_FAN)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(HOT_FAN - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(per_key.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
