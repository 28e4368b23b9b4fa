"""Best-fit packing of token sequences, with bins certified by lower bounds and repacked where they have gaps.

Every document is its ids and one end id; longer ones are cut into full sequences, the
first piece taking what is left over. Full pieces fill a sequence each. The others are
dealt into partitions of bounded size and packed best-fit decreasing. A dual-feasible
lower bound certifies the bin count of each partition. Certified partitions give back
their emptiest bin, those with a gap every bin that is not full; these pieces change
partitions and are packed again, in ever fewer partitions, until one partition is left
or a round leaves as many as it found: dealing the same pieces again would gain nothing.

Null and empty texts are one end id. Each row is packed by itself, so repeated rows and
ids are kept; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import map_arrow, materialise

CAPACITY = 2048
#: Pieces of a partition.
PARTITION_PIECES = 100_000
#: Sequence ids of a partition.
PARTITION_IDS = 1 << 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Tokens that a tokenizer file adds to its vocabulary, and their ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens with rules for what is around them: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every document, with the CRC-32 of their ids; added tokens count as such within texts."""
    added = added or {}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        out = [[] for _ in range(5)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = vocab.encode_added(text or "", added)
            ids.append(end_id)
            raw = np.array(ids, "<u4").tobytes()
            for i, (start, length) in enumerate(cut(len(ids), capacity)):
                for column, value in zip(out, (doc_id, i, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = with_free[free].pop()
            if not with_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - size:
            with_free[left].append(b)
            mask |= 1 << left
    return bins, offsets


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs, by dual-feasible functions.

    histogram[x] counts pieces of length x. The functions: the identity; u_k, which rounds
    (k + 1) x / capacity; and for each t the function that counts lengths over capacity - t
    as whole bins and drops those under t.
    """
    x = np.arange(len(histogram), dtype=np.int64)
    h = histogram.astype(np.int64)
    total = int((x * h).sum())
    best = -(-total // capacity)
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        u = np.where(whole, x * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((u * h).sum()) // (k * capacity)))
    count, mass = np.cumsum(h), np.cumsum(x * h)
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = mass[capacity - t] - mass[t - 1]
    return max(best, int((large - (-middle // capacity)).max()))


def certified(histogram: Iterable[tuple[int, int]], capacity: int) -> int:
    """lower_bound of (length, count) pairs."""
    h = np.zeros(capacity + 1, np.int64)
    for length, count in histogram:
        h[length] += count
    return lower_bound(h, capacity)


def _pack_partition(capacity: int, final: bool):
    """Packs one partition; marks the bins that stay as they are.

    If the count meets the bound the partition is certified: all bins but the emptiest stay.
    Else it has a gap, and only its full bins stay. The pieces of the other bins go on to
    another partition.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if len(fill) == bound:
            closed = np.full(len(fill), True)
            closed[np.argmin(fill)] = fill.min() == capacity
        else:
            closed = fill == capacity
        return pdf.assign(bin=bins, offset=offsets, closed=(closed | final)[bins])

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    sequence_id counts partitions over all rounds, PARTITION_IDS each, then bins; those of full pieces are negative.
    """
    columns = parts.columns
    rows = parts.withColumn("row", F.monotonically_increasing_id())
    out = rows.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity)
    schema = f"{PIECES}, row long, part long, bin long, offset long, closed boolean"
    n, before, first, r = rest.count(), None, 0, 0
    while n:
        n_parts = -(-n // partition_pieces)
        final = n_parts == 1 or n_parts == before
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(n_parts)))
        packed = materialise(dealt.groupBy("part").applyInPandas(_pack_partition(capacity, final), schema), "packed")
        sequence = (F.col("part") + F.lit(first)) * F.lit(PARTITION_IDS) + F.col("bin")
        out = out.unionByName(packed.where("closed").select(*columns, sequence.alias("sequence_id"), "offset"))
        rest = packed.where(~F.col("closed")).select(*columns, "row")
        n, before, first, r = 0 if final else rest.count(), n_parts, first + n_parts, r + 1
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, sequences that any packing needs). Gathers one count for each length."""
    used = packed.select("sequence_id").distinct().count()
    return used, certified(((x["length"], x["count"]) for x in packed.groupBy("length").count().toLocalIterator()), capacity)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, added: dict[str, int] | None = None) -> DataFrame:
    """Tokens of the documents, packed. The pieces are written once and read by each round."""
    return pack(materialise(pieces(docs, path, end_id, capacity, added), "pieces"), capacity)
