"""SimHash near-duplicate groups by pivot distance tables.

Fingerprints that differ in at most `RADIUS` = 2 bits are linked; a group is everything
reachable over links. Distinct fingerprints get a table of Hamming distances to fixed
reference fingerprints (pivots). The triangle inequality bounds a pair's distance from
below by the largest difference of their table coordinates, so pairs that differ by more
than 2 in any coordinate are discarded, and the others are verified bit by bit.

Which pairs meet at all comes from the same table. Every pivot is a reference over the whole
fingerprint, or one with the bits of one of five blocks turned. The difference of both distances
is decided by the block's bits alone. Two differing bits touch at most two blocks, so in three
blocks at least the differences for all references are equal. Pairs are looked for among
fingerprints with equal coordinates in one of the ten triples of blocks.

A bucket with more than `BUCKET` distinct fingerprints is not searched by pairs. There
each fingerprint is compared with its own 64 neighbours at one bit: two that share a
neighbour are within 2 of each other by the triangle inequality, and any two within 2
share one. So the work stays in proportion to the rows whatever a bucket holds.

keep_one() can link texts by the Jaccard similarity of their shingles instead (see similar), of
which 0.8 means about ten differing bits, often 15. Hardly a block stays equal then, so there
each text has VIEWS more fingerprints whose shingles have weights, and in each block others:
u ** -3 for a u in (0, 1) from the shingle's hash. Few shingles outweigh the rest in a block,
and texts at 0.8 share them more often than not, so its bits differ all together or not at
all. Pairs are those with equal coordinates in four blocks of a view. The distances of
the plain fingerprints to the pivots, and their bits, discard pairs beyond the radius of the
similarity; the sets of shingles verify.

Null, empty and white-space texts have fingerprint zero and are linked like any other.
Repeated rows give repeated result rows; a null doc_id takes part, and counts as larger
than any id. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, null_safe_bytes
from .similar import MIX, similar_sets

RADIUS = 2
SEED = 42
SHINGLE_WORDS = 3
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Reference fingerprints over all bits; each is also taken with the bits of one block turned.
REFERENCES = 7
#: Distinct fingerprints of a bucket that are still compared by pairs.
BUCKET = 1024
MAX_ROUNDS = 60
#: Fingerprints with weights, of texts that are linked by similarity.
VIEWS = 9
_RANDOM = np.random.default_rng(9)
FACTORS = _RANDOM.integers(1 << 63, size=(VIEWS, len(BLOCKS)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(1 << 63, size=(VIEWS, len(BLOCKS)), dtype=np.uint64)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text's words, in order, repeats included."""
    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), SEED)], np.uint64)
    return np.array([digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def weighted_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """VIEWS fingerprints of each of these sets of shingle hashes, none of which is empty.

    A bit is 1 if the shingles that have it outweigh the others. Both the weights and the bits of
    the shingles are of the block: the weight is in the upper half of a mixed hash, the bits in the lower.
    """
    data, heads = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), VIEWS), np.uint64)
    for view in range(VIEWS):
        for block, (low, high) in enumerate(BLOCKS):
            x = data * FACTORS[view, block] + TERMS[view, block]
            x = (x ^ (x >> np.uint64(32))) * MIX
            x ^= x >> np.uint64(29)
            u = ((x >> np.uint64(32)).astype(np.float32) + np.float32(1)) * np.float32(2**-32)
            weights = (1 / (u * u * u)).view(np.uint32)
            places = np.arange(high - low, dtype=np.uint32)[:, None]
            signs = (x.astype(np.uint32) << places) & np.uint32(1 << 31)  # turns the sign of a float32
            ones = np.add.reduceat((signs ^ weights).view(np.float32), heads, axis=1) < 0
            out[:, view] |= np.bitwise_or.reduce(ones.astype(np.uint64) << (places + low).astype(np.uint64), axis=0)
    return out


def radius_of(similarity: float) -> int:
    """Bits in which plain fingerprints of texts of this similarity differ, and 5 standard deviations more.

    A bit differs with the angle between two sets as vectors, whose cosine is 2s / (1 + s) at least.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * share + 5 * math.sqrt(64 * share * (1 - share)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in null_safe_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots() -> list[list[int]]:
    """The pivots, all over the whole fingerprint: for each reference itself, and with each block's bits turned."""
    turned = [0, *(sum(1 << b for b in range(*block)) for block in BLOCKS)]
    return [[xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) ^ t for t in turned] for k in range(REFERENCES)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds the distances of fp to all pivots, d0..d5: the k-th byte of d0 is that to the k-th reference,
    and of d1..d5 those to the reference with that block turned."""
    columns = {}
    for i in range(len(BLOCKS) + 1):
        packed = F.lit(0).cast("long")
        for k, row in enumerate(pivots()):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(row[i])))).cast("long"), 8 * k))
        columns[f"d{i}"] = packed
    return fps.withColumns(columns)


def coordinates(i: int) -> Column:
    """What turning a block does to the distances to all references, as one number.

    A distance and that to the turned pivot differ by a number that only the bits of the block decide,
    so fingerprints that differ elsewhere alone have equal coordinates. (Bytes of d0 and d1..d5 are 64
    at most; 128 in each keeps them from borrowing.)
    """
    high = F.lit(0x80808080808080)
    return F.col("d0").bitwiseOR(high) - F.col(f"d{i + 1}")


def block_keys(blocks: int, *first: Column) -> Column:
    """A key for each choice of so many blocks of what pivot_table() returns: equal where their coordinates and `first` are."""
    return F.array(*(F.xxhash64(*first, F.lit(t), *(coordinates(i) for i in chosen)) for t, chosen in enumerate(combinations(range(len(BLOCKS)), blocks))))


def meeting_places(sets: DataFrame) -> DataFrame:
    """(node, key) of sets with `views`, their fingerprints with weights; sets that meet share a key."""
    table = pivot_table(sets.select("node", F.posexplode("views").alias("view", "fp")))
    return table.select("node", F.explode(block_keys(4, F.col("view"))).alias("key"))


def _close(a: str, b: str, radius: int = RADIUS) -> Column:
    """No distance to a pivot differs by more than the radius, and neither do the fingerprints themselves."""

    def at(side: str, i: int, k: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{side}.d{i}"), 8 * k).bitwiseAND(F.lit(255))

    kept = F.lit(True)
    for i in range(len(BLOCKS) + 1):
        for k in range(REFERENCES):
            kept = kept & (F.abs(at(a, i, k) - at(b, i, k)) <= radius)
    return kept & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints fps.fp that connect all those within RADIUS."""
    table = pivot_table(fps.select("fp"))
    rows = materialise(table.select(*table.columns, F.explode(block_keys(3)).alias("key")), "pivot_rows")
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pivot_buckets")
    small = rows.join(sizes.where(F.col("n") <= bucket).select("key"), "key", "left_semi")
    found = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _close("x", "y")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    large = sizes.where(F.col("n") > bucket).select("key")
    if not large.isEmpty():
        hot = rows.join(large, "key", "left_semi").select("fp").distinct()
        near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)))
        meet = hot.select("fp", F.explode(near).alias("near"))
        least = meet.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(meet.join(least, "near").where("a < fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges (a, b); root is the smallest node reachable.

    Labels spread to neighbours and then jump to their label's label, so a chain halves each round.
    Every round is written, so that lineage stays short.
    """
    both = materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))), "edges")
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("seen"))
        spread = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("next"))
        moved = materialise(spread.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("root"), (F.coalesce("next", "to") != F.col("root")).alias("moved")), "labels")
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every document."""
    fps = materialise(fingerprints(docs), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, bucket))
    named = classes.join(roots, classes.fp == roots.node)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    linked = materialise(named.join(least, "root").select("fp", "component"), "components")
    reached = classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(materialise(reached, "reached"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """The documents without their near-duplicates: of each group the smallest doc_id stays.

    Without a similarity, groups are those of near_duplicates(); with one, those of texts whose sets
    of shingles have this Jaccard similarity or more (see similar). Rows are told apart by a number
    that is written with them: rows of one doc_id in different groups stay, and of rows in one group
    one stays. A row without a doc_id cannot be named as another's duplicate, so it stays. The list
    of rows that go is joined rather than that of those that stay, as it is the shorter.
    """
    row = "_row"
    while row in docs.columns:
        row = "_" + row
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

    def shingles(text: bytes) -> np.ndarray:
        return shingle_hashes(text, words)

    if similarity is None:

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(shingles(t)) for t in null_safe_bytes(batch.column(2))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["row", "doc_id", "node"])

        numbered = held.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        marks = materialise(map_arrow(numbered, kernel, "row long, doc_id long, node long"), "fingerprints")
        roots = components(links(materialise(marks.select(F.col("node").alias("fp")).distinct(), "classes")))
    else:

        def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            return np.array([fingerprint(x) for x in sets], np.uint64), weighted_fingerprints(sets)

        marks, roots = similar_sets(held, row, shingles, similarity, sketch, pivot_table, meeting_places, _close("x", "y", radius_of(similarity)), components)
    named = marks.where(F.col("doc_id").isNotNull()).select("row", "doc_id", "node").join(roots.select("node", "root"), "node", "left")
    named = materialise(named.select("row", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("n")).where("n > 1").select("root", F.col("least.row").alias("first"))
    gone = materialise(named.join(materialise(first, "first"), "root").where(F.col("row") != F.col("first")).select(F.col("row").alias(row)), "gone")
    return held.join(gone, row, "left_anti").select(*docs.columns)
