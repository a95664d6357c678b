import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylvan.llm import sharding
from sylvan.llm.sharding import assign_shards


def check(df, shards, pairs):
    rows = df.collect()
    assert len(rows) == len(pairs)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        text = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_near_equal_with_a_hot_text(docs_of):
    pairs = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 17)) for i in range(6000)]
    df = assign_shards(docs_of(pairs), 8)
    sizes = check(df, 8, pairs)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.04 * mean and min(sizes.values()) > 0.96 * mean
    assert df.columns.count("shard") == 1


def test_nulls_repeats_and_empty(docs_of):
    pairs = [(None, None), (None, None), (1, ""), (1, "a"), (1, "a"), (2, "x" * 100_000)]
    check(assign_shards(docs_of(pairs), 4), 4, pairs)
    assert assign_shards(docs_of([]), 4).collect() == []


def test_columns_named_like_working_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i, "p", 1.5) for i in range(9)], "doc_id bigint, text string, _k bigint, _PART string, size double")
    rows = assign_shards(docs, 3).collect()
    assert sorted((r.doc_id, r._k, r._PART) for r in rows) == [(i, i, "p") for i in range(9)]
    assert all(r["size"] == len(r.text) + 16 for r in rows)


@pytest.mark.parametrize("doc_id", ["cast(null as bigint)", "id % 3", "7"])
@pytest.mark.parametrize("text", ["concat('text ', id, repeat(' x', int(id % 40)))", "if(id % 3 = 0, repeat('same ', 9), concat('t', id))", "'one text'"])
def test_ids_that_tell_nothing(spark, doc_id, text):
    """Null ids, few ids and rows that are equal throughout don't tip the law."""
    docs = spark.range(60_000).select(F.expr(doc_id).alias("doc_id"), F.expr(text).alias("text"))
    out = assign_shards(docs, 40).groupBy("shard").agg(F.sum("size"), F.count("*"), F.count_distinct("slot"), F.max("slot")).collect()
    sizes = [r[1] for r in out]
    assert len(out) == 40 and sum(r[2] for r in out) == 60_000
    assert all(r[2] == r[3] == r[4] + 1 for r in out)
    mean = sum(sizes) / 40
    assert 0.96 * mean < min(sizes) and max(sizes) < 1.04 * mean


def test_the_sample_is_bounded(spark):
    """However many rows share a key, and whatever their sizes, the draw stays near SAMPLES for each range."""
    keys = spark.range(300_000).select(F.xxhash64("id").alias("_k"), F.xxhash64("id", F.lit(1)).alias("_r"), (16 + F.col("id") % 7 * 5000).alias("size"))
    total = keys.agg(F.sum("size")).first()[0]
    step = total / (sharding.SAMPLES * 100)
    assert keys.where(sharding._share("_r") * step < F.col("size")).count() < 1.2 * sharding.SAMPLES * 100
    assert 90 <= len(sharding.splitters(keys, total, 100)) <= 100
