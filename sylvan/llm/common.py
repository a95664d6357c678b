"""Column names and text rules that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Up to so many rows of a few longs or hashes are broadcast.
BROADCAST_ROWS = 500_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case: working columns may then take them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_few(written: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for a broadcast where it has BROADCAST_ROWS at most."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def give_back() -> None:
    """Return to the system what this process has freed: allocators keep it otherwise, and a worker idles beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def sparing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches (mapInPandas, mapInArrow) whose worker gives memory back when its task is done."""

    def work(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return work


def sparing_groups(run: Callable[[tuple, pd.DataFrame], pd.DataFrame]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """A function over groups (applyInPandas) whose worker gives memory back after each."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(key, pdf)
        give_back()
        return out

    return work
