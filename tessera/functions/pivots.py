"""Which vectors need not be compared: cells around pivots, and the triangle inequality.

Every point belongs to the cell of its nearest pivot. No point of a cell is nearer to a query than
the query's distance to the pivot less the cell's radius, nor than half of how much further that
pivot is than the query's own. A few scouts of each cell give a query's first bound on its k-th
distance, and cells whose least distance is beyond it are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tiles
from .lineage import cut
from .vectors import arrays_of, matrix_of

#: Pivots of 64 numbers at most, more of shorter ones, so that what is gathered is bounded: this many pivots and, for k neighbours, 2 k scouts for each.
MOST = 512
#: Vectors whose distances to all pivots are held at a time.
AT_ONCE = 1_024


@dataclass
class Blocks:
    """Cells put together, neighbours with neighbours, or split, to blocks of about equal size."""

    first: np.ndarray
    parts: np.ndarray
    n: int

    @classmethod
    def of(cls, counts: np.ndarray, order: np.ndarray, wanted: int) -> Blocks:
        first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        size, at, filled = max(1, math.ceil(counts.sum() / max(1, wanted))), 0, 0
        for cell in order:
            if filled and filled + counts[cell] > size:
                at, filled = at + 1, 0
            first[cell], parts[cell] = at, max(1, math.ceil(counts[cell] / size))
            at, filled = (at + parts[cell], 0) if parts[cell] > 1 else (at, filled + counts[cell])
        return cls(first, parts, int(at + (filled > 0)) or 1)

    def block(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[cells] + mixed.astype(np.int64) % self.parts[cells]


@dataclass
class Pivots:
    centers: np.ndarray
    radius: np.ndarray
    counts: np.ndarray

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(tiles.squared_distances(v, self.centers), 0))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and its distance to the pivot."""
        cell = tiles.squared_distances(v, self.centers).argmin(1)
        return cell, tiles.exact_distances(v, self.centers, np.arange(len(v)), cell)

    def least(self, d: np.ndarray) -> np.ndarray:
        """Lower bounds on the distance to each cell's points, of distances to the pivots; rounding is given away."""
        bound = np.maximum(d - self.radius, (d - d.min(1, keepdims=True)) / 2)
        return np.maximum(bound - 1e-6 * (1 + np.abs(self.centers).max(initial=0.0) + d), 0)

    def least_of(self, v: np.ndarray, nearest: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """least() for some cells only; nearest: the distances of v to their own pivots."""
        d = np.sqrt(np.maximum(tiles.squared_distances(v, self.centers[cells]), 0))
        bound = np.maximum(d - self.radius[cells], (d - nearest[:, None]) / 2)
        return np.maximum(bound - 1e-6 * (1 + np.abs(self.centers).max(initial=0.0) + d), 0)

    def most(self, d: np.ndarray, k: int) -> np.ndarray:
        """Upper bounds on the k-th distance: the cells that hold k + 1 points lie within."""
        far = d + self.radius
        order = far.argsort(1)
        enough = np.cumsum(self.counts[order], 1) > k
        at = np.where(enough.any(1), enough.argmax(1), -1)
        out = np.full(len(d), np.inf)
        ok = at >= 0
        out[ok] = far[ok, order[ok, at[ok]]]
        return out

    def order(self) -> np.ndarray:
        """Cells along the direction in which pivots differ most."""
        x = self.centers - self.centers.mean(0)
        return (x @ np.linalg.svd(x, full_matrices=False)[2][0]).argsort(kind="stable") if len(x) > 1 else np.arange(len(x))


def in_cells(points: DataFrame, n_pivots: int) -> tuple[DataFrame, Pivots]:
    """(id, v, cell, d) of points (id, v), and the pivots: the points of the least hashes."""
    width = (points.select(F.size("v")).first() or [1])[0]
    picked = points.orderBy(F.xxhash64("id"), "id").limit(min(n_pivots, MOST * max(1, 64 // max(1, width)))).collect()
    centers = np.unique(np.array([r["v"] for r in picked], float), axis=0)
    found = Pivots(centers, np.zeros(len(centers)), np.zeros(len(centers)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, d = found.nearest(matrix_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(d)], ["id", "v", "cell", "d"])

    out = cut(points.mapInArrow(assign, "id long, v array<double>, cell long, d double"))
    for r in out.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
        found.counts[r["cell"]], found.radius[r["cell"]] = r["n"], r["r"] * (1 + 1e-9)
    return out, found


def scouts(points: DataFrame, n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of n points of each cell, those of the least hashes."""
    x = points.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(1)), "id"))).where(F.col("_r") <= n)
    out: dict[int, list] = {}
    for r in x.select("cell", "id", "v").collect():
        out.setdefault(r["cell"], []).append((r["id"], r["v"]))
    return {c: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)) for c, rows in out.items()}


def bounded(queries: DataFrame, pivots: Pivots, found: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """id, v, cell, bound of queries (id, v): no k-th neighbour is further than the bound."""
    sent = queries.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            every, m = batch.column(0).to_numpy(), matrix_of(batch.column(1))
            for at in range(0, len(every), AT_ONCE):
                ids, v = every[at : at + AT_ONCE], m[at : at + AT_ONCE]
                d = pivots.distances(v)
                cell, bound = d.argmin(1), np.full(len(v), np.inf)
                for c in np.unique(cell):
                    rows = np.flatnonzero(cell == c)
                    others, w = sent.value.get(int(c), (np.zeros(0), v[:0]))
                    if len(others) > k:
                        near = tiles.squared_distances(v[rows], w) + tiles.slack(v[rows], w)[:, None]
                        near[ids[rows][:, None] == others[None]] = np.inf
                        bound[rows] = np.sqrt(np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1], 0))
                few = np.flatnonzero(~np.isfinite(bound))
                bound[few] = pivots.most(d[few], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids), arrays_of(v), pa.array(cell, pa.int64()), pa.array(bound * (1 + 1e-9))], ["id", "v", "cell", "bound"])

    return queries.mapInArrow(run, "id long, v array<double>, cell long, bound double")


def with_needs(queries: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds needs, the number of points in the cells that may hold one within the bound, to (id, v, cell, bound)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v, bound = matrix_of(batch.column(1)), batch.column(3).to_numpy()
                needs = [(pivots.least(pivots.distances(v[at : at + AT_ONCE])) <= bound[at : at + AT_ONCE, None]) @ pivots.counts for at in range(0, len(v), AT_ONCE)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(needs))], ["id", "v", "cell", "bound", "needs"])

    return queries.mapInArrow(run, "id long, v array<double>, cell long, bound double, needs double")
