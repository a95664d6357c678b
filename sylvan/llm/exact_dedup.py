"""Exact dedup with a cuckoo-filter index.

Every document is reduced to the SHA-256 of its normalised text. Digests are dealt to buckets; each bucket keeps a cuckoo
filter over its live digests beside the digests themselves. A digest that the filter does not know is new and is inserted.
A hit is verified against the digests stored in the bucket, so that a clash of fingerprints never joins two texts. When an
insertion overflows, the filter is rebuilt at twice the size from the stored digests. Digests can be deleted from the
index, and texts that come back later are then new again.

Cases: a null text counts as empty; a very long text is hashed like any other, in the JVM, and never moved; of equal texts the
smallest doc_id stays, so ties are copies that repeat it; rows that repeat a doc_id are counted one by one; a null doc_id never becomes keep_id
unless all of its group are null; an empty table gives an empty index and no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import join_per_key, materialize

from .common import SPACE_CLASS, broadcast_if_few, free_name, sparing_groups, text_or_empty

#: Fingerprints in a cell of the filter, moves before an insertion gives up, rows for each bucket of the index.
CELL, MOVES, BUCKET_ROWS = 4, 200, 20_000
#: Rows that a digest's copies are combined to before they meet in their bucket.
SALTS = 16
INDEX = "bucket int, cells int, filter binary, digests array<binary>, keep_ids array<bigint>, sizes array<bigint>"


class CuckooFilter:
    """Partial-key cuckoo hashing of digests, 16-bit fingerprints, CELL to a cell, with deletion and resizing.

    It holds one fingerprint for each live digest; stored: the live digests, from which a larger filter is built.
    """

    def __init__(self, cells: int = 64, table: Iterable[int] | None = None):
        self.cells = max(2, 1 << (cells - 1).bit_length())
        self.table = list(table) if table is not None else [0] * (self.cells * CELL)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[10:18], "little") & (self.cells - 1)
        return mark, one, self._other(one, mark)

    def _other(self, cell: int, mark: int) -> int:
        return (cell ^ (mark * 0x5BD1E995 >> 7)) & (self.cells - 1)

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        return mark in self.table[one * CELL : one * CELL + CELL] or mark in self.table[two * CELL : two * CELL + CELL]

    def _put(self, cell: int, mark: int) -> bool:
        for i in range(cell * CELL, cell * CELL + CELL):
            if not self.table[i]:
                self.table[i] = mark
                return True
        return False

    def insert(self, digest: bytes, stored: Iterable[bytes]) -> None:
        """Add a digest that isn't live. stored: all live digests but this one, read only on overflow."""
        mark, one, two = self._places(digest)
        if self._put(one, mark) or self._put(two, mark):
            return
        cell = two
        for turn in range(MOVES):
            i = cell * CELL + turn % CELL
            self.table[i], mark = mark, self.table[i]
            cell = self._other(cell, mark)
            if self._put(cell, mark):
                return
        self.resize([*stored, digest])

    def resize(self, stored: list[bytes]) -> None:
        """Rebuild from the stored digests at twice the cells, again if that overflows too."""
        self.cells *= 2
        self.table = [0] * (self.cells * CELL)
        done: list[bytes] = []
        for digest in stored:
            self.insert(digest, done)  # a nested rebuild takes those done and this one
            done.append(digest)

    def delete(self, digest: bytes) -> None:
        """Take a live digest out."""
        mark, one, two = self._places(digest)
        for cell in (one, two):
            for i in range(cell * CELL, cell * CELL + CELL):
                if self.table[i] == mark:
                    self.table[i] = 0
                    return
        raise KeyError(digest)

    def to_bytes(self) -> bytes:
        return np.asarray(self.table, "<u2").tobytes()

    @classmethod
    def from_bytes(cls, cells: int, data: bytes) -> CuckooFilter:
        return cls(cells, np.frombuffer(data, "<u2").tolist())


class Bucket:
    """The live digests of one bucket with keep_id and size, behind their filter."""

    def __init__(self, row=None):
        self.filter, self.live = CuckooFilter(), {}
        if row is not None:
            self.filter = CuckooFilter.from_bytes(int(row["cells"]), row["filter"])
            self.live = {bytes(d): [k, int(n)] for d, k, n in zip(row["digests"], row["keep_ids"], row["sizes"], strict=True)}

    def add(self, digest: bytes, doc_id, count: int) -> None:
        if digest in self.filter and (own := self.live.get(digest)) is not None:  # a hit, verified against what is stored
            own[0] = doc_id if own[0] is None else own[0] if doc_id is None else min(own[0], doc_id)
            own[1] += count
        else:
            self.filter.insert(digest, self.live)
            self.live[digest] = [doc_id, count]

    def remove(self, digest: bytes) -> bool:
        if digest in self.filter and digest in self.live:
            self.filter.delete(digest)
            del self.live[digest]
            return True
        return False

    def row(self, bucket: int) -> pd.DataFrame:
        kept = list(self.live.values())
        out = {"bucket": [bucket], "cells": [self.filter.cells], "filter": [self.filter.to_bytes()], "digests": [list(self.live)]}
        return pd.DataFrame(out | {"keep_ids": [[k for k, _ in kept]], "sizes": [[n for _, n in kept]]})


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE_CLASS + "+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 (binary) of each row's normalised text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("digest"))


def combined(hashed: DataFrame) -> DataFrame:
    """digest, keep_id and group_size, at most SALTS rows for each digest, however many rows of hashed have it."""
    salt = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(SALTS))
    grouped = hashed.groupBy("digest", salt.alias("_salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return grouped.select("digest", "keep_id", "group_size")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def build_index(hashed: DataFrame, buckets: int) -> DataFrame:
    """The index of digests(docs): one row for each bucket, with its filter, live digests, keep_ids and sizes."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Bucket()
        ids = pdf.keep_id.astype("Int64")
        for d, k, n in zip(pdf.digest, ids.where(ids.notna(), None).tolist(), pdf.group_size.tolist(), strict=True):
            own.add(bytes(d), None if k is pd.NA or k is None else int(k), n)
        return own.row(int(key[0]))

    return combined(hashed).withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(sparing_groups(build), INDEX)


def delete_digests(index: DataFrame, gone: DataFrame, buckets: int) -> DataFrame:
    """The index without the digests in gone (column digest); digests that aren't live are ignored."""

    def cut(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["bucket", "cells", "filter", "digests", "keep_ids", "sizes"])
        own = Bucket(left.iloc[0])
        for d in right.digest:
            own.remove(bytes(d))
        return own.row(int(key[0]))

    dealt = gone.select("digest").distinct().withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(cut, INDEX)


def groups_of(index: DataFrame) -> DataFrame:
    """digest, keep_id and group_size of every live digest."""
    rows = index.select(F.explode(F.arrays_zip("digests", "keep_ids", "sizes")).alias("x"))
    return rows.select(F.col("x.digests").alias("digest"), F.col("x.keep_ids").alias("keep_id"), F.col("x.sizes").alias("group_size"))


def exact_dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays. Where rows repeat that doc_id, they all are kept = true: they
    can't be told apart by id. A hot group of copies is combined before it meets in its bucket, and salted in the join.
    """
    hashed = materialize(digests(docs), "digests")
    total = hashed.count()
    groups = materialize(groups_of(build_index(hashed, max(1, -(-total // bucket_rows)))), "groups")
    out = join_per_key(hashed, groups, ["digest"], "group_size", total, ["doc_id"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns unchanged.

    Rows that repeat the kept doc_id with an equal text stay with it. A null in another column, an empty or very long text and
    clashing names need no care: only doc_id and text are read; an empty table gives no rows.
    """
    gone = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"))
    gone = materialize(gone.distinct(), "gone")
    few = broadcast_if_few(gone)
    sha = free_name(docs, "_sha")
    rows = docs.withColumn(sha, F.sha2(normalised(), 256))
    same = rows["doc_id"].cast("bigint").eqNullSafe(few["_gone_id"]) & (rows[sha] == few["_gone_sha"])
    return rows.join(few, same, "left_anti").drop(sha)
