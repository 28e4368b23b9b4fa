"""Groups of texts by the Jaccard similarity of their word shingles.

Texts are linked whose sets of shingles have a similarity of `similarity` or more; a group is
everything reachable over links. Candidates come from SimHash fingerprints and their distances to
pivots (see simhash): sets with equal coordinates in four of the five blocks of one of nine
fingerprints share a bucket. Every link is verified on the sets themselves.

In a bucket all sets are compared with one of them first, and the links found make groups.
Then pairs of sets that are in different groups still are compared. So a large group of near
copies costs work in proportion to its rows, and no pair of a bucket is left out that could
join two groups. The first centre of a bucket is the set that shares most, which in a family of
near copies is the text they come from. Three things discard pairs before they are verified:
the sizes; the parities of the members' hashes in 1024 places, which cannot differ in more places
than the sets in members (both lose no pair); and the distances of the plain fingerprints to the
pivots and to each other, 5 standard deviations beyond what is expected at the limit.

Equal sets are one, named by 64 bits. Null and empty texts have the empty set, and are equal.

MinHash signatures and their bands are what the recall of these candidates is compared with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, null_safe_bytes

BANDS, BAND_VALUES = 20, 5
#: Values of which four bits each are compared.
SKETCHED = 96
#: Places of the parities, 64 in a long.
PARITY_BITS = 1024
LEAST_SIMILARITY = 0.8
SLICE = 1 << 20
#: What discards pairs.
MEASURED = ("size", "parity", "fp", *(f"d{i}" for i in range(6)))
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(1 << 63, size=BANDS * BAND_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(1 << 63, size=BANDS * BAND_VALUES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each of these sets, none of which is empty."""
    data = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    heads = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat(data * a + b, heads) for a, b in zip(FACTORS, TERMS, strict=True)], axis=1)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), BANDS), np.uint64)
    for i in range(BANDS):
        x = np.full(len(values), i + 1, np.uint64) * MIX
        for j in range(BAND_VALUES):
            x = (x ^ values[:, i * BAND_VALUES + j]) * MIX
            x ^= x >> np.uint64(32)
        keys[:, i] = x
    return keys


def parities(members: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS places, whether an odd number of members falls there."""
    odd = np.bincount((members % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_name(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes(), 42) if len(members) else 0


def least_agreement(similarity: float) -> int:
    """Values of a sketch that two sets of this similarity have in common, less 5 standard deviations."""
    p = similarity + (1 - similarity) / 16
    return math.floor(SKETCHED * p - 5 * math.sqrt(SKETCHED * p * (1 - p)))


def is_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _sketch_batch(shingles, sketch):
    """row, doc_id, node (the set's name), size, parity, fp and views of texts."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t)) for t in null_safe_bytes(batch.column(2))]
        names = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
        fps, views, parity = np.zeros(len(sets), np.uint64), [None] * len(sets), [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            fps[full], found = sketch([sets[i] for i in full])
            for i, v in zip(full, found.view(np.int64).tolist(), strict=True):
                views[i], parity[i] = v, parities(sets[i]).tolist()
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array([len(s) for s in sets], pa.int64()), pa.array(parity, longs), pa.array(fps.view(np.int64)), pa.array(views, longs)], ["row", "doc_id", "node", "size", "parity", "fp", "views"])

    return kernel


def _may_be_similar(similarity: float) -> Column:
    """False for pairs x, y that are certainly not, by their sizes and parities."""
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    differ = F.lit(0)
    for i in range(PARITY_BITS // 64):
        differ = differ + F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i]))
    most = (small + large) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (small >= similarity * large - 1e-6) & (differ <= most)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingles, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; nodes has the row of a text of each set, texts has them by row."""

    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t)).tobytes() for t in null_safe_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "members"])

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = ([np.frombuffer(m, np.uint64) for m in batch.column(i).to_pylist()] for i in (2, 3))
        return batch.select([0, 1]).filter(pa.array([is_similar(x, y, similarity) for x, y in zip(*sides, strict=True)], pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    used = materialise(nodes.join(used, "node").select("node", "row"), "used_sets")
    sets = materialise(map_arrow(texts.select("row", "text").join(used, "row").select("node", "text"), sets_of, "node long, members binary", SLICE), "shingle_members")
    x, y = sets.withColumnsRenamed({"node": "a", "members": "x"}), sets.withColumnsRenamed({"node": "b", "members": "y"})
    return materialise(map_arrow(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y"), verify, "a long, b long"), "similar")


def similar_sets(held: DataFrame, row: str, shingles, similarity: float, sketch, pivot_table, places, close: Column, components) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, node of every text; node, root of the sets in groups of more than one).

    held is a written table with `row`, a number of each of its rows, doc_id and text. shingles gives
    the hashes of a text, sketch the plain fingerprint of each of some sets and those with weights,
    pivot_table adds the distances of fp to the pivots, places gives the keys at which sets meet,
    close says of a pair x, y whether fp may be those of similar sets, components the roots of edges (a, b).
    """
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"signatures are made for similarities of {LEAST_SIMILARITY} or more")
    texts = held.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = materialise(map_arrow(texts, _sketch_batch(shingles, sketch), "row long, doc_id long, node long, size long, parity array<long>, fp long, views array<long>", SLICE), "sketches")
    nodes = materialise(marks.groupBy("node").agg(F.min("row").alias("row")), "shingle_sets")
    chosen = materialise(pivot_table(marks.join(nodes, ["node", "row"]).select("node", "size", "parity", "fp", "views")), "chosen_sketches")
    placed = places(chosen)
    sizes = materialise(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared_keys")
    # most places are of one set alone: sketches join those that are not
    shared = materialise(placed.join(sizes, "key"), "shared_places")
    # a set that many others are near to shares more places with more sets than they do
    popular = shared.groupBy("node").agg(F.sum("n").alias("popularity"))
    shared = materialise(shared.join(popular, "node").join(chosen.select("node", *MEASURED), "node").select("key", "node", *MEASURED, "popularity"), "shared_sketches")
    centres = shared.groupBy("key").agg(F.max(F.struct("popularity", "node", *MEASURED)).alias("y")).select("key", "y.node", *(f"y.{c}" for c in MEASURED))

    may_be = _may_be_similar(similarity) & close
    ordered = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    stars = shared.alias("x").join(centres.alias("y"), "key").where((F.col("x.node") != F.col("y.node")) & may_be).select(*ordered)
    stars = materialise(stars.distinct(), "star_pairs")
    links = _verified(stars, nodes, texts, shingles, similarity)
    roots = materialise(components(links), "star_roots")

    grouped = shared.join(roots, "node", "left").select("key", "node", *MEASURED, F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = materialise(grouped.join(mixed, "key", "left_semi"), "mixed_places")
    crossing = rest.alias("x").join(rest.alias("y"), "key").where((F.col("x.root") < F.col("y.root")) & may_be).select(*ordered)
    crossing = materialise(crossing.distinct().join(stars, ["a", "b"], "left_anti"), "crossing_pairs")
    if crossing.isEmpty():
        return marks, roots
    more = _verified(crossing, nodes, texts, shingles, similarity)
    return marks, materialise(components(links.unionByName(more)), "roots")
