"""Sums of vectors by key, computed in Arrow batches.

A kernel turns a batch of rows into a few keyed sums; what moves between tasks is one row for
each batch and key, whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_of(column: pa.Array) -> np.ndarray:
    """An array<double> column of equal lengths as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def arrays_of(m: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an array<double> column."""
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), pa.float64()))


def keyed_sums(df: DataFrame, kernel: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """key, total, s: sums over all batches of the kernel's (keys, totals, vectors)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys, totals, sums = kernel(batch)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(totals, pa.float64()), arrays_of(sums)], ["key", "total", "s"])

    return summed(df.mapInArrow(run, SUMS))


SUMS = "key long, total double, s array<double>"


def task_sums(df: DataFrame, kernel: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], None], n_keys: int, width: int) -> DataFrame:
    """The same where the kernel adds each batch to a task's (totals, vectors): one row for each task and key."""

    def run(batches):
        totals, sums = np.zeros(n_keys), np.zeros((n_keys, width))
        for batch in batches:
            if batch.num_rows:
                kernel(batch, totals, sums)
        keys = np.flatnonzero(totals)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(totals[keys]), arrays_of(sums[keys])], ["key", "total", "s"])

    return summed(df.mapInArrow(run, SUMS))


def summed(parts: DataFrame) -> DataFrame:
    """key, total, s: the sums of rows of one key."""
    element = parts.select("key", "total", F.posexplode("s").alias("i", "e")).groupBy("key", "i").agg(F.sum("total").alias("total"), F.sum("e").alias("e"))
    return element.groupBy("key").agg(F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"]).alias("s"))


def gathered(sums: DataFrame, n_keys: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, vectors) of keyed sums over keys 0..n_keys - 1, which the caller bounds."""
    totals, vectors = np.zeros(n_keys), np.zeros((n_keys, width))
    for r in sums.collect():
        totals[r["key"]], vectors[r["key"]] = r["total"], r["s"]
    return totals, vectors
