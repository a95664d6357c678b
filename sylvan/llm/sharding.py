"""Sharding by sampled splitters.

The key of a record is the hash of its text, then a hash of its doc_id and text, so that equal texts are neighbours. A
size-weighted sample of keys (a key is drawn with a probability in proportion to its bytes) gives quantile boundaries of
many small ranges. One pass adds up the true bytes and rows of each range; a range that came out overfull, as one with a
hot text does, is subdivided by the second hash. Whole (sub)ranges in key order then fill the shards up to their share of
the bytes, so that a shard is off by one small range at most. Slots count from the start of the range, so no task has to
number a whole shard.

Rows that are equal in doc_id and text can't be told apart by hashes. Where such a group outweighs a range, the rows are
written once with a number each, which then joins the second hash.

Cases: a null text has 0 bytes of text, the crc32 of the empty text and is a neighbour of empty texts; a null or repeated
doc_id is a value like another; repeated rows get a slot each; rows that tie in both hashes take their slots in any order; a
text larger than a share of the bytes makes its shard larger by as much, as no text is cut; an empty table gives no rows.
Other columns pass unchanged; columns named like the results are replaced.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.runtime import discard, materialize

from .common import free_name, text_or_empty, without

#: Ranges: one for each RANGE_BYTES, at least so many a shard and no more than MOST_RANGES in all (what the driver and a
#: broadcast hold); samples for each range.
RANGE_BYTES, RANGES_PER_SHARD, MOST_RANGES, SAMPLES = 64 << 20, 64, 1 << 16, 8
WORKING = ("_k", "_r", "_n", "_range", "_part", "_shard", "_base", "_cell", "_first", "_in", "_parts")
#: Bytes that a record costs besides its text.
RECORD_BYTES = 16


def record_bytes() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(RECORD_BYTES)).cast("bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with size, text_crc32, _k (key) and _r (second key)."""
    keys = {"_k": F.xxhash64(text_or_empty()), "_r": F.xxhash64(F.lit(1), F.col("doc_id").cast("string"), text_or_empty())}
    return docs.withColumns({"size": record_bytes(), "text_crc32": F.crc32(text_or_empty())} | keys)


def _share(hash_column: str) -> Column:
    """A hash as a number from 0 to 1."""
    return (F.col(hash_column) / F.lit(2.0**64)) + 0.5


def splitters(keys: DataFrame, total: int, ranges: int) -> list[int]:
    """Upper bounds (exclusive) of all ranges but the last, from a size-weighted sample of keys (_k, _r, unique, and size).

    A key is drawn with probability size / step, so some SAMPLES * ranges keys come to the driver, however many rows have one key.
    """
    step = max(1.0, total / (SAMPLES * ranges))  # bytes for each sample
    weight = F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w")
    drawn = keys.where(_share("_r") * step < F.col("size")).select("_k", weight).toPandas().sort_values("_k")
    if not len(drawn):
        return []
    at = drawn.w.cumsum() / drawn.w.sum() * ranges
    return sorted({int(k) for k, new in zip(drawn._k, at.astype("int64").diff().fillna(0) > 0, strict=True) if new})


def _with_range(rows: DataFrame, bounds: list[int], bits: int) -> DataFrame:
    """rows with _range: how many bounds are at or below _k. Bounds are looked up by the leading bits of the key."""
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for b in bounds:
        cells[(b >> (64 - bits)) + (1 << (bits - 1))].append(b)
    first = [0, *accumulate(len(c) for c in cells)][:-1]
    own = pd.DataFrame({"_cell": range(1 << bits), "_first": first, "_in": cells})
    table = rows.sparkSession.createDataFrame(own, "_cell bigint, _first int, _in array<bigint>")
    placed = rows.withColumn("_cell", F.shiftright("_k", 64 - bits) + (1 << (bits - 1))).join(F.broadcast(table), "_cell")
    below = F.size(F.filter("_in", lambda b: b <= F.col("_k")))
    return placed.withColumn("_range", F.col("_first") + below).drop("_cell", "_first", "_in")


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot (gapless in the shard) and grown_shard (null)."""
    kept = without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    aside = {c: free_name(kept, f"{c}_aside") for c in kept.columns if c.lower() in WORKING}  # renamed, and back at the end
    rows = _keyed(kept.withColumnsRenamed(aside))
    keys = materialize(rows.select("_k", "_r", "size"), "keys")
    per_key = materialize(keys.groupBy("_k", "_r").agg(F.sum("size").alias("size")), "per_key")
    total, heaviest = (x or 0 for x in per_key.agg(F.sum("size"), F.max("size")).first())
    ranges = min(MOST_RANGES, max(RANGES_PER_SHARD * shards, total // RANGE_BYTES))
    aim = max(1, total // ranges)
    if heaviest > aim and keys.groupBy("_k", "_r").count().where("count > 1").limit(1).count():
        rows = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered")
        rows = rows.withColumn("_r", F.xxhash64("_r", "_n")).drop("_n")
        per_key = keys = materialize(rows.select("_k", "_r", "size"), "keys")
    bounds, bits = splitters(per_key, total, ranges), max(1, (ranges - 1).bit_length())
    full = _with_range(keys, bounds, bits).groupBy("_range").agg(F.sum("size").alias("b"))
    #: Parts of each range: one, or as many as its bytes need. At most 2 * ranges in all.
    parts = full.select("_range", F.greatest(F.lit(1), F.ceil(F.col("b") / F.lit(2.0 * aim))).cast("int").alias("_parts")).toPandas()
    table = docs.sparkSession.createDataFrame(parts.astype({"_range": "int64", "_parts": "int64"}), "_range bigint, _parts bigint")

    def divided(x: DataFrame) -> DataFrame:
        ranged = _with_range(x, bounds, bits).join(F.broadcast(table), "_range")
        return ranged.withColumn("_part", F.floor(_share("_r") * F.col("_parts"))).drop("_parts")

    found = divided(keys).groupBy("_range", "_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas()
    discard(keys, per_key)
    found = found.sort_values(["_range", "_part"])
    #: A range goes to the shard in which its middle byte falls.
    middle = found.b.cumsum() - found.b / 2
    found["_shard"] = (middle * shards // max(1, total)).clip(0, shards - 1).astype("int32")
    found["_base"] = found.groupby("_shard").n.cumsum() - found.n
    names = ["_range", "_part", "_shard", "_base"]
    placed = docs.sparkSession.createDataFrame(found[names].astype("int64"), ", ".join(f"{c} bigint" for c in names))
    order = Window.partitionBy("_range", "_part").orderBy("_k", "_r")
    out = divided(rows).join(F.broadcast(placed), ["_range", "_part"])
    slot = (F.col("_base") + F.row_number().over(order) - 1).cast("bigint")
    results = {"law": F.lit("bytes"), "shard": F.col("_shard").cast("int"), "slot": slot, "grown_shard": F.lit(None).cast("int")}
    return out.withColumns(results).drop(*WORKING).withColumnsRenamed({v: k for k, v in aside.items()})


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write docs below path, a folder for each shard, rows in order of slot within each file."""
    dealt = assign_shards(docs, shards).repartition("shard", F.floor(F.col("slot") / 100_000))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
