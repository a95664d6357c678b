"""Line dedup: lines that many documents share are dropped but for one document.

Lines are exploded with their position, normalised and hashed (128 bits); documents are counted for each hash, and the
lines over the threshold go. The rest is put together again by position.

Cases: a null or empty text is one empty line; a null doc_id counts as one document and never is the one that keeps a
line; rows that repeat a doc_id count as one document; rows that are equal get equal results. An empty table gives no
rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import join_per_key, materialize

from .common import LOWER, SPACES, UPPER, text_or_empty


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines() -> Column:
    return F.split(text_or_empty(), "\n", -1)


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, _th (hash of the text) and _pos (from 0) of each line to drop."""
    found = (
        docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(text_or_empty()).alias("_th"), F.posexplode(F.transform(_lines(), lambda x: F.when(F.length(x) >= min_chars, line_key(x)))).alias("_pos", "_key"))
        .where(F.length("_key") >= min_chars)
        .select("doc_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    found = materialize(found, "lines")
    docs_per_line = found.groupBy("_h1", "_h2", "doc_id").agg(F.count("*").alias("_n")).groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_rows"), F.max("doc_id").alias("_keeps"))
    over = materialize(docs_per_line.where(F.col("_docs") >= min_docs), "over")
    hits = join_per_key(found, over, ["_h1", "_h2"], "_rows", found.count(), ["doc_id", "_pos"])
    return hits.where(~F.col("doc_id").eqNullSafe(F.col("_keeps"))).select("doc_id", "_th", "_pos")


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text (what stays), n_lines and n_dropped for each row of docs."""
    drops = shared_lines(docs, min_chars, min_docs).groupBy("doc_id", "_th").agg(F.collect_set("_pos").alias("_drop"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64(text_or_empty()).alias("_th"))
    both = rows.alias("a").join(drops.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._th") == F.col("b._th")), "left").select("a.doc_id", _lines_of("a.text").alias("_lines"), text_or_empty("a.text").alias("_text"), "b._drop")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return both.select("doc_id", kept.alias("text"), F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"))


def _lines_of(name: str) -> Column:
    return F.split(text_or_empty(name), "\n", -1)


def line_dedup_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    out = drop_shared_lines(docs, min_chars, min_docs)
    return out.select("doc_id", "n_lines", F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(F.lit(0)).cast("bigint").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
