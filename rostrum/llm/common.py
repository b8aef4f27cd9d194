"""Helpers that every operator of this package shares, besides those of `rostrum.storage`: tables, memory, grouped streams."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rostrum.storage import cut, discard, eager, new_path, shared_dir, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no malloc_trim outside glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable) -> Callable:
    """`run`, a function of Arrow batches, giving its worker's freed memory back to the system when it ends."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold complete groups only, from batches sorted by integer columns `keys`; bounded by a batch plus a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first, end = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and first != last
        starts = np.flatnonzero(change)
        if len(starts):
            split = int(starts[-1])
            done = [*held, batch.slice(0, split)] if split else held
            if done:
                yield pa.Table.from_batches(done)
            held = [batch.slice(split)]
        else:
            held.append(batch)
        last = end
    if held:
        yield pa.Table.from_batches(held)


__all__ = ["cut", "discard", "eager", "frugal", "give_back", "new_path", "shared_dir", "small", "table", "whole_groups"]
