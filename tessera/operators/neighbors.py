"""Exact nearest neighbours, the graphs built on them, and mixing metrics.

An embedding is rows (cell_id, v array<double>). A task of the neighbour search holds some query
vectors and their best k so far, and streams points past them (functions.tiles). What may be among
the best by products is compared by differences, so equal vectors tie, and go by the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tiles
from ..functions.lineage import cut
from ..functions.order import medians
from ..functions.pivots import AT_ONCE, Blocks, Pivots, bounded, in_cells, scouts, with_needs
from ..functions.vectors import arrays_of, matrix_of
from .stats import joined


#: Streamed vectors that are compared at a time.
CHUNK = 2_048


def _true(x: np.ndarray) -> np.ndarray:
    """Positions of the few that are true in the flattened array, looked for by eight."""
    flat = x.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    row, col = np.nonzero(flat.reshape(-1, 8)[words])
    return words[row] * 8 + col


class _Nearest:
    """The best k of each held vector, by distance and then id.

    Products in single precision, with what rounding may change given away, tell what may be among the best; only that is compared by differences.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.ids, self.v, self.k = ids, v, k
        self.d, self.to = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        #: No neighbour further than this counts; the k-th distance so far.
        self.bound, self.kth = np.full(len(ids), np.inf) if bound is None else bound, np.full(len(ids), np.inf)
        finite = v[np.isfinite(v).all(1)]
        self.center = finite.mean(0) if len(finite) else np.zeros(v.shape[1])
        self.scale = np.abs(finite - self.center).max(initial=0.0) or 1.0
        x = (v - self.center) / self.scale
        self.norms = (x * x).sum(1)
        self.single = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
        #: Of a product of the norms, many times over.
        self.error = (v.shape[1] + 8) * 2.0**-22
        self.room = np.empty(tiles.PIECE * CHUNK, np.float32)
        #: What was found since the best of a piece were last taken: rows of the piece, ids, distances.
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, ids: np.ndarray, v: np.ndarray, _: pa.Array) -> None:
        for at in range(0, len(ids), CHUNK):
            part = self.streamed(ids[at : at + CHUNK], v[at : at + CHUNK])
            for piece in tiles.pieces(len(self.ids)):
                self.compare(piece, slice(None), *part)

    def streamed(self, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids and vectors, and these in single precision. Less half the squared norm, a product is the larger the nearer."""
        y = (v - self.center) / self.scale
        norms = (y * y).sum(1)
        if not (norms < 1e30).all():  # single precision ends there; what is no number is near nothing
            kept = np.isfinite(norms)
            ids, v, y, norms = ids[kept], v[kept], y[kept], norms[kept]
            if not (norms < 1e30).all():
                return ids, v, np.hstack([y, ((1.5 * self.error - 0.5) * norms)[:, None]])
        return ids, v, np.hstack([y, ((1.5 * self.error - 0.5) * norms)[:, None]]).astype(np.float32)

    def compare(self, piece: slice, some: slice | np.ndarray, ids: np.ndarray, v: np.ndarray, single: np.ndarray) -> None:
        """some: rows of the piece."""
        held = self.single[piece][some]
        n, m = len(held), len(ids)
        if not m:
            return
        near = np.matmul(held, single.T, out=self.room[: n * m].reshape(n, m)) if single.dtype == np.float32 else held @ single.T
        limit, norms = np.minimum(self.kth[piece], self.bound[piece])[some], self.norms[piece][some]
        with np.errstate(invalid="ignore", over="ignore"):
            least = (norms - (limit / self.scale) ** 2 * (1 + 1e-9)) / 2 - self.error * norms
            first = np.isinf(limit)
            if first.any() and m > self.k:
                # the held vector itself may be one of these k + 1
                kth = np.partition(near[first], m - self.k - 1, axis=1)[:, m - self.k - 1].astype(float)
                least[first] = kth - 8 * self.error * (norms[first] + np.abs(kth))
            found = _true(near >= np.nextafter((least - 1e-35).astype(near.dtype), -np.inf, dtype=near.dtype)[:, None])
        row, col = np.divmod(found, m)
        row = np.arange(len(self.ids[piece]))[some][row]
        other = self.ids[piece][row] != ids[col]
        row, col = row[other], col[other]
        waiting = self.waiting.setdefault(piece.start, [])
        if len(row):
            waiting.append((row, ids[col], tiles.exact_distances(self.v[piece], v, row, col)))
        if first.any() or sum(len(r) for r, _, _ in waiting) > len(self.ids[piece]) * self.k // 2:
            self._merge(piece)

    def _merge(self, piece: slice) -> None:
        waiting = self.waiting.pop(piece.start, [])
        if not waiting:
            return
        row, to, d = (np.concatenate(x) for x in zip(*waiting, strict=True))
        n = len(self.d[piece])
        order = np.argsort(row, kind="stable")
        row, to, d = row[order], to[order], d[order]
        sizes = np.bincount(row, minlength=n)
        place = self.k + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        far, whom = np.full((n, self.k + sizes.max()), np.inf), np.full((n, self.k + sizes.max()), -1, np.int64)
        far[:, : self.k], whom[:, : self.k] = self.d[piece], self.to[piece]
        far[row, place], whom[row, place] = d, to
        best = np.argpartition(far, self.k - 1, axis=1)[:, : self.k]
        kth = np.take_along_axis(far, best, 1).max(1)
        for i in np.flatnonzero(((far <= kth[:, None]).sum(1) > self.k) & np.isfinite(kth)):  # of equal distances the smaller ids
            best[i] = np.lexsort((whom[i], far[i]))[: self.k]
        self.d[piece], self.to[piece], self.kth[piece] = np.take_along_axis(far, best, 1), np.take_along_axis(whom, best, 1), kth

    def rows(self) -> pa.RecordBatch:
        for piece in tiles.pieces(len(self.ids)):
            self._merge(piece)
        row, col = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.to[row, col]), pa.array(self.d[row, col])], ["src", "dst", "d"])


class _NearestInCells(_Nearest):
    """The same for points that come cell by cell: a cell is compared with the queries that it may hold neighbours of."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, k: int, pivots: Pivots, compared: Accumulator | None):
        cell, d = (np.concatenate(x) for x in zip(*(pivots.nearest(v[piece]) for piece in tiles.pieces(len(v))), strict=True)) if len(v) else (np.zeros(0, int), np.zeros(0))
        order = np.lexsort((d, cell))  # neighbours in a piece, which then needs few cells
        super().__init__(ids[order], v[order], k, bound[order])
        self.nearest, self.pivots, self.compared = d[order], pivots, compared

    def add(self, ids: np.ndarray, v: np.ndarray, cells: pa.Array) -> None:
        cells = cells.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.array([0, *(np.flatnonzero(np.diff(cells)) + 1)])
        parts = [(int(cells[a]), slice(at, min(at + CHUNK, b))) for a, b in zip(starts, [*starts[1:], len(cells)], strict=True) for at in range(a, b, CHUNK)]
        ready, seen = {}, np.unique(cells)
        for piece in tiles.pieces(len(self.ids)):
            least = self.pivots.least_of(self.v[piece], self.nearest[piece], seen)
            for cell, at in parts:
                rows = np.flatnonzero(least[:, np.searchsorted(seen, cell)] <= np.minimum(self.kth[piece], self.bound[piece]))
                if not len(rows):
                    continue
                if at.start not in ready:
                    ready[at.start] = self.streamed(ids[at], v[at])
                self.compare(piece, slice(None) if len(rows) == len(least) else rows, *ready[at.start])
                if self.compared is not None:
                    self.compared.add(len(rows) * (at.stop - at.start))


class _Farthest(_Nearest):
    """The k-th distance of each held vector that has k."""

    def rows(self) -> pa.RecordBatch:
        for piece in tiles.pieces(len(self.ids)):
            self._merge(piece)
        enough = np.isfinite(self.kth)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[enough]), pa.array(self.kth[enough])], ["id", "far"])


#: Queries and points of a cell that are compared for a bound; what is more goes to parts.
OF_CELL = 4_096


def _within_cells(left: DataFrame, right: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """left (id, v, cell, bound) with the k-th distance among the points (id, v, cell) of the query's own cell as its bound, where that is less."""
    sizes = {r["cell"]: r["count"] for r in left.groupBy("cell").count().collect()}
    parts = np.array([max(1, math.ceil(max(n, sizes.get(c, 0)) / OF_CELL)) for c, n in enumerate(pivots.counts)])
    firsts = np.cumsum(parts) - parts

    def to_parts(batches):
        for batch in batches:
            if batch.num_rows:
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                tile = Blocks(firsts, parts, 0).block(cell, ids)
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), *batch.columns[:2], pa.array(np.zeros(len(ids)))], ["tile", "id", "v", "x"])

    sent = [x.select("id", "v", "cell").mapInArrow(to_parts, "tile int, id long, v array<double>, x double") for x in (left, right)]
    far = tiles.chosen(*sent, lambda ids, v, _: _Farthest(ids, v, k), "id long, far double", int(parts.sum()))
    return left.join(far, "id", "left").select("id", "v", "cell", F.least("bound", F.col("far") * (1 + 1e-9)).alias("bound"))


def knn_in_cells(queries: DataFrame, k: int, points: DataFrame | None = None, block_rows: int = tiles.HOLD, n_pivots: int | None = None, compared: Accumulator | None = None, share: float | None = None) -> DataFrame:
    """knn() of many points. Cells around pivots that cannot hold a neighbour of a query are not sent to it, nor compared.

    Queries and points go to blocks of neighbouring cells; a query goes to the blocks that hold a cell it
    needs, a point to the rows of queries that need its block. What structure the points lack is what cannot be
    left out: where more than the share of all pairs would be compared, the task grid does it. The result is written, so
    that it is found once however often it is read. compared: counts pairs.
    """
    vectors = lambda emb: emb.select(F.col("cell_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    right = vectors(queries if points is None else points)
    m = right.count()
    empty = queries.sparkSession.createDataFrame([], "src long, dst long, rank int, d double")
    if m == 0:
        return empty
    right, pivots = in_cells(right, n_pivots or max(1, math.isqrt(m)))
    left = cut(with_needs(_within_cells(cut(bounded(vectors(queries), pivots, scouts(right, 2 * k + 2), k)), right, pivots, k), pivots))
    asks = left.agg(F.sum("needs"), F.count("*")).first()
    if share is not None and (asks[0] or 0) > share * m * asks[1]:
        return cut(_in_grid(left.select("id", "v", F.col("bound").alias("x")), right.select("id", "v", F.lit(None).cast("double").alias("x")), k, block_rows, asks[1], m))
    of_cell = {r["cell"]: r["count"] for r in left.groupBy("cell").count().collect()}
    held = np.array([of_cell.get(c, 0) for c in range(len(pivots.counts))])
    n = int(held.sum())
    if n == 0:
        return empty
    order, tasks = pivots.order(), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = Blocks.of(held, order, max(math.ceil(n / block_rows), min(math.isqrt(tasks) + 1, math.ceil(n / tiles.LEAST))))
    across = Blocks.of(pivots.counts.astype(np.int64), order, max(math.isqrt(tasks) + 1, min(down.n, len(order))))
    needs = np.zeros((len(order), across.n), np.float32)
    for c in range(len(order)):
        needs[c, across.first[c] : across.first[c] + across.parts[c]] = 1

    def to_tiles(batches):
        for batch in batches:
            if batch.num_rows:
                every, m = batch.column(0).to_numpy(), matrix_of(batch.column(1))
                for at in range(0, len(every), AT_ONCE):
                    ids, v, cell, bound = (x[at : at + AT_ONCE] for x in (every, m, batch.column(2).to_numpy(), batch.column(3).to_numpy()))
                    wanted = (pivots.least(pivots.distances(v)) <= bound[:, None]) & (pivots.counts > 0)
                    row, block = np.nonzero(wanted.astype(np.float32) @ needs > 0)
                    tile = down.block(cell, ids)[row] * across.n + block
                    yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(ids[row]), arrays_of(v[row]), pa.array(bound[row])], ["tile", "id", "v", "x"])

    asked = cut(left.mapInArrow(to_tiles, "tile int, id long, v array<double>, x double"))
    rows_of: dict[int, list[int]] = {}
    for r in asked.select("tile").distinct().toLocalIterator():
        rows_of.setdefault(r["tile"] % across.n, []).append(r["tile"] // across.n)

    def to_rows(batches):
        for batch in batches:
            if batch.num_rows:
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                block = across.block(cell, ids)
                to = [rows_of.get(int(b), []) for b in block]
                row = np.repeat(np.arange(len(ids)), [len(t) for t in to])
                tile = np.array([t for x in to for t in x], np.int64) * across.n + block[row]
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(ids[row]), arrays_of(matrix_of(batch.column(1))[row]), pa.array(cell[row].astype(float))], ["tile", "id", "v", "x"])

    sent = right.mapInArrow(to_rows, "tile int, id long, v array<double>, x double")
    near = tiles.chosen(asked, sent, lambda ids, v, x: _NearestInCells(ids, v, x.to_numpy(zero_copy_only=False), k, pivots, compared), "src long, dst long, d double", sum(map(len, rows_of.values())))
    return cut(_best(near, k))


#: Share of the pairs from which cells leave out too little.
SHARE = 0.5
#: Bytes of vectors that a task holds in the grid of a search, and at most so many of them; pairs for which a task of its own pays.
HELD_BYTES, HELD, PAIRS = 1 << 25, 65_536, 200_000_000


def _in_grid(left: DataFrame, right: DataFrame, k: int, block_rows: int, n: int, m: int) -> DataFrame:
    """Both sides: id, v, x (of left: a bound on the k-th distance). n and m vectors.

    Tasks hold more than those of other kernels, so that less is sent; and as every column of tasks finds k of its own for each query, there are fewer columns than rows.
    """
    width = left.select(F.size("v")).first()[0]
    hold = max(block_rows, min(HELD, HELD_BYTES // (8 * max(1, width))))
    context = left.sparkSession.sparkContext
    tasks = max(1, min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * context.defaultParallelism), math.ceil(n * m / PAIRS)))
    one = 8 * width + 40
    down = max(math.ceil(n / hold), min(tasks, round(math.sqrt(tasks * n / m * (one + 80 * k) / one))), 1)
    near = tiles.tiled(left, right, lambda ids, v, x: _Nearest(ids, v, k, x.to_numpy(zero_copy_only=False)), "src long, dst long, d double", grid=(down, max(1, math.ceil(tasks / down))))
    return _best(near, k)


def _best(near: DataFrame, k: int) -> DataFrame:
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("rank") <= k).select("src", "dst", "rank", "d")


def knn(queries: DataFrame, k: int, points: DataFrame | None = None, block_rows: int = tiles.HOLD) -> DataFrame:
    """src, dst, rank, d: the k nearest points of each query, itself (its id) left out. A task holds block_rows queries at most.

    More points than a task holds are searched by cells (knn_in_cells), with the same result.
    """
    if not (queries if points is None else points).offset(block_rows).isEmpty():
        return knn_in_cells(queries, k, points, block_rows, share=SHARE)

    def side(emb: DataFrame) -> DataFrame:
        return emb.select(F.col("cell_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("double").alias("x"))

    near = tiles.tiled(side(queries), side(queries if points is None else points), lambda ids, v, _: _Nearest(ids, v, k), "src long, dst long, d double", block_rows)
    return _best(near, k)


def knn_graph(near: DataFrame, mode: str = "connectivity") -> DataFrame:
    """src, dst, w: both directions of every neighbour pair, duplicates kept."""
    w = F.lit(1.0) if mode == "connectivity" else F.exp(-F.col("d") * F.col("d"))
    one = near.select("src", "dst", w.alias("w"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def adaptive_graph(emb: DataFrame, k_min: int = 5, k_max: int = 30) -> DataFrame:
    """src, dst, w: k by local density, Gaussian weights scaled by the k_min-th distance, both directions."""
    near = cut(knn(emb, k_max))
    own = near.groupBy("src").agg((1.0 / (F.avg(F.when(F.col("rank") <= k_min, F.col("d"))) + 1e-8)).alias("density"), F.max(F.when(F.col("rank") <= k_min, F.col("d"))).alias("sigma"))
    span = own.agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    dens = (F.col("density") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)
    k_i = F.greatest(F.lit(1), F.least(F.lit(k_max), k_min + F.floor((1 - dens) * (k_max - k_min))))
    x = near.join(own.crossJoin(F.broadcast(span)).select("src", "sigma", k_i.alias("k_i")), "src").where("rank <= k_i")
    one = x.select("src", "dst", F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma") + 1e-8)).alias("w"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def snn_weights(edges: DataFrame) -> DataFrame:
    """src, dst, w: Jaccard of the ends' neighbour sets by different edge, over the greatest of all."""
    pairs = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    sets = pairs.groupBy("src").agg(F.collect_set("dst").alias("s"))
    x = edges.select("src", "dst").distinct().join(sets, "src").join(sets.select(F.col("src").alias("dst"), F.col("s").alias("t")), "dst")
    x = x.select("src", "dst", (F.size(F.array_intersect("s", "t")) / F.greatest(F.size(F.array_union("s", "t")), F.lit(1))).alias("j"))
    return x.crossJoin(F.broadcast(x.agg(F.max("j").alias("m")))).select("src", "dst", F.when(F.col("m") > 0, F.col("j") / F.col("m")).otherwise(F.col("j")).alias("w"))


def mutual_neighbors(reference: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """ref, query: pairs that are among each other's k nearest across two batches."""
    a = knn(query, k, reference).select(F.col("src").alias("query"), F.col("dst").alias("ref"))
    b = knn(reference, k, query).select(F.col("src").alias("ref"), F.col("dst").alias("query"))
    return a.join(b, ["ref", "query"]).select("ref", "query")


def _labelled(near: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    return near.join(labels.select(F.col("cell_id").alias("dst"), F.col(label).alias("l")), "dst")


def lisi(near: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """cell_id, lisi: inverse Simpson index of labels among k neighbours (counts over k)."""
    c = _labelled(near, labels, label).groupBy("src", "l").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("src").alias("cell_id")).agg((1.0 / F.sum(F.col("n") * F.col("n") / (float(k) * k))).alias("lisi"))


def batch_mixing(near: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """cell_id, batch, entropy: entropy of neighbour batches over the log of their number."""
    batches = labels.agg(F.count_distinct(label).alias("nb"))
    c = _labelled(near, labels, label).groupBy("src", "l").agg((F.count("*") / k).alias("p"))
    e = c.groupBy("src").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("h"))
    x = e.crossJoin(F.broadcast(batches)).join(labels.select(F.col("cell_id").alias("src"), F.col(label).alias("batch")), "src")
    return x.select(F.col("src").alias("cell_id"), "batch", F.when(F.col("nb") > 1, F.col("h") / F.ln("nb")).otherwise(0.0).alias("entropy"))


def mixing_summary(mixing: DataFrame) -> DataFrame:
    """batch, mean, median of the entropy; the row without a batch is over all."""
    means = mixing.rollup("batch").agg(F.avg("entropy").alias("mean"))
    middle = medians(mixing, "entropy", "batch").unionByName(medians(mixing, "entropy").withColumn("batch", F.lit(None).cast(mixing.schema["batch"].dataType)))
    return joined(means, middle, ["batch"])


def kbet(near: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """One row: acceptance, the share of cells whose neighbourhood looks like the whole."""
    n = labels.count()
    whole = labels.groupBy(F.col(label).alias("l")).agg((F.count("*") / n).alias("g"))
    grid = near.select("src").distinct().join(F.broadcast(whole))
    local = _labelled(near, labels, label).groupBy("src", "l").agg((F.count("*") / k).alias("p"))
    x = grid.join(local, ["src", "l"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    s = x.groupBy("src").agg(F.sum((F.col("p") - F.col("g")) ** 2 / (F.col("g") + 1e-10)).alias("s"), F.count("*").alias("nb"))
    return s.agg(F.avg((F.col("s") < 0.05 * F.col("nb")).cast("double")).alias("acceptance"))


def paga_connectivity(near: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """c1, c2, weight: neighbour edges between clusters over what their sizes would give, symmetrised."""
    own = labels.select(F.col("cell_id").alias("src"), F.col(label).alias("c1"))
    e = _labelled(near, labels, label).join(own, "src").groupBy("c1", F.col("l").alias("c2")).agg(F.count("*").alias("n"))
    both = e.unionAll(e.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "n")).where("c1 <> c2").groupBy("c1", "c2").agg((F.sum("n") / 2.0).alias("n"))
    sizes = labels.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("s"))
    total = labels.agg(F.count("*").alias("t"))
    x = both.join(F.broadcast(sizes.select(F.col("c").alias("c1"), F.col("s").alias("s1"))), "c1").join(F.broadcast(sizes.select(F.col("c").alias("c2"), F.col("s").alias("s2"))), "c2").crossJoin(F.broadcast(total))
    return x.select("c1", "c2", (F.col("n") / (F.col("s1") * F.col("s2") * k / F.col("t"))).alias("weight"))
