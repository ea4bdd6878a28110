"""Whole rows carried beside what an operator computes, so that no column name of theirs can clash with its own."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``; ``select("row.*")`` brings them back, names and values as they were."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def gives_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that returns freed memory to the system after a task's last batch. Python workers live on from stage
    to stage, beside an executor's heap, and would else keep what the largest batch took."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
            trim(0)

    return run
