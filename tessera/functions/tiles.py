"""Every row of one side against every row of another, without listing pairs.

Tasks form a grid: a task holds the vectors of one row of it and streams those of one column, so a
vector is sent once for each task in its row or column, about the root of the number of tasks.
A kernel folds what it streams into what it holds and gives its rows at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix_of

#: Vectors a task holds at most, and the fewest for which a task of its own pays.
HOLD, LEAST = 16_384, 256
#: Held vectors that are compared at a time with a batch.
PIECE = 256


class Kernel(Protocol):
    def add(self, ids: np.ndarray, v: np.ndarray, x: pa.Array) -> None: ...

    def rows(self) -> pa.RecordBatch: ...


def pieces(n: int) -> Iterator[slice]:
    return (slice(at, at + PIECE) for at in range(0, n, PIECE))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By products, so equal vectors need not give exactly 0."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What rounding may change a row of squared_distances by, many times over."""
    return 1e-9 * ((a * a).sum(1) + (b * b).sum(1).max(initial=0.0))


def exact_distances(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the pairs (row, col) by differences."""
    steps = [slice(at, at + 65_536) for at in range(0, len(row), 65_536)]
    return np.concatenate([np.sqrt(((a[row[s]] - b[col[s]]) ** 2).sum(1)) for s in steps]) if steps else np.zeros(0)


def _grid(n: int, m: int, tasks: int, hold: int) -> tuple[int, int]:
    """Rows and columns of tasks for n held and m streamed vectors."""
    down = max(1, math.ceil(n / hold), min(math.ceil(math.sqrt(tasks)), math.ceil(n / LEAST)))
    return down, max(1, min(math.ceil(tasks / down), math.ceil(m / LEAST)))


def tiled(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, pa.Array], Kernel], schema: str, hold: int = HOLD, grid: tuple[int, int] | None = None) -> DataFrame:
    """Rows of kernel(ids, vectors, x of held rows of left) after it has seen rows of right. Both sides: id long, v array<double>, x.

    A row of left is held by several tasks, each of which sees a share of right, so the caller merges their rows. grid: rows and columns of tasks.
    """
    down, across = grid or _grid(left.count(), right.count(), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), hold)

    def side(df: DataFrame, streamed: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(across if streamed else down)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit((down if streamed else across) - 1)))
        x = df.select("id", "v", "x", own.alias("own"), others.alias("other"))
        at = F.col("other") * across + F.col("own") if streamed else F.col("own") * across + F.col("other")
        return x.select(at.cast("int").alias("tile"), F.lit(int(streamed)).alias("side"), "id", "v", "x")

    both = side(left, False).unionByName(side(right, True)).repartitionById(down * across, F.col("tile"))
    return both.sortWithinPartitions("tile", "side").mapInArrow(_folded(kernel), schema)


def chosen(left: DataFrame, right: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, pa.Array], Kernel], schema: str, tiles: int) -> DataFrame:
    """The same for tiles that the caller has chosen. Both sides: tile int, id long, v array<double>, x double, by which a tile's rows are ordered."""
    marked = left.select("tile", F.lit(0).alias("side"), "id", "v", "x").unionByName(right.select("tile", F.lit(1).alias("side"), "id", "v", "x"))
    parts = max(1, min(tiles, 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) + tiles // 16))
    return marked.repartition(parts, "tile").sortWithinPartitions("tile", "side", "x").mapInArrow(_folded(kernel), schema)


def _folded(kernel: Callable[[np.ndarray, np.ndarray, pa.Array], Kernel]) -> Callable:
    """Rows of (tile, side, id, v, x), ordered by the first two: the held ones, then the streamed ones of each tile."""

    def run(batches):
        tile, held, found = None, [], None
        for batch in batches:
            kind = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            ends = [*(np.flatnonzero(np.diff(kind)) + 1), len(kind)]
            for start, end in zip([0, *ends], ends, strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if kind[start] // 2 != tile:
                    if found is not None:
                        yield found.rows()
                    tile, held, found = kind[start] // 2, [], None
                if kind[start] % 2 == 0:
                    held.append(part)
                    continue
                if found is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    found = kernel(*_columns(whole))
                    held = []
                if found is not None:
                    found.add(*_columns(part))
        if found is not None:
            yield found.rows()

    return run


def _columns(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, v, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (part.column(i) for i in (2, 3, 4)))
    return ids.to_numpy(zero_copy_only=False), matrix_of(v), x
