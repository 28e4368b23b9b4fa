"""Exact substring removal with suffix arrays.

Every byte covered by a string of `WIDTH` bytes that also starts anywhere else is removed.
Each window of WIDTH bytes is tied to an anchor: the least hash of the strings of `GRAM`
bytes within it. Equal windows have equal anchors at equal places, so all windows of one
anchor can be judged together, and the windows of a text fall into runs with one anchor each.

1. Equal texts become one, with their number. Anchors are counted. One that occurs once in all
   texts ties no repeated window.
2. For each anchor that occurs again, the bytes of its run of windows (its context) go to the
   shard of the anchor. Equal contexts are one, with a count.
3. Each shard is a suffix array, built by induced sorting; windows whose common prefix with
   a neighbour in the array reaches WIDTH are repeated, and so are those of equal contexts. An
   anchor with one context, however often, needs none.
4. The repeated runs go back to their texts and the bytes they cover are taken out.

An anchor with more than `MAX_CONTEXTS` different contexts (a passage in a large share of all
texts) would make its shard grow with the input. Its contexts are split by the distance of the
window from the anchor, in halves, each half going by the bytes that all its windows share;
this repeats until a group is small, and ends at single windows, where equal ones are one.

Null and empty texts, and those shorter than WIDTH, lose nothing. A repeated row is another
place, so rows with equal texts of WIDTH bytes or more lose all their bytes. Removal may cut
a character; remove_repeats() drops such remains so that its texts stay valid. Texts are named
by 128 bits of their SHA-256, never by doc_id, which may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, null_safe_bytes
from .suffix import repeated_windows

WIDTH = 200
GRAM = 64
#: Bytes of the contexts of one suffix array, about.
SHARD_BYTES = 2 << 20
MAX_CONTEXTS = 1024
#: Bytes whose anchors are searched at once, and bytes of texts in a slice: arrays of eight bytes for each of them are in memory.
BLOCK = 1 << 18
TEXT_BYTES = 2 << 20
LOW = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on that has so many."""

    def mix(x: np.ndarray, step: int, factor: int) -> np.ndarray:
        y = x[:-step] * np.uint64(factor) + (x[step:] ^ x[step:] >> np.uint64(29))
        y *= np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(32)
        return y

    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    for step, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (32, 0xD6E8FEB86659FD93)):
        x = mix(x, step, factor)
    return x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, hash, anchor, first, last) of each run of windows with one anchor.

    anchor, first and last are positions in the text: where the anchor starts, and the first
    and last window tied to it. Of equal hashes the leftmost in the window counts.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(lengths) - lengths
    n_windows = len(data) - width + 1
    if n_windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    stop = start + lengths
    found = []
    for a in range(0, n_windows, BLOCK):
        b = min(n_windows, a + BLOCK)
        text_of = np.searchsorted(stop, np.arange(a, b), side="right")
        ok = np.flatnonzero(np.arange(a, b) + width <= stop[text_of])
        if not len(ok):
            continue
        h = gram_hashes(data[a : b + width - 1])
        least = sliding_least((h & ~LOW) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1)
        where = (least & LOW).astype(np.int64)
        q, t, p = where[ok] + a, text_of[ok], ok + a
        new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (t[1:] != t[:-1])))
        found.append((t[new], h[q[new] - a].view(np.int64), q[new], p[new], np.append(p[new[1:] - 1], p[-1])))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    t, h, q, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run that a block's end has cut goes on in the next block
    goes_on = np.append(False, (q[1:] == q[:-1]) & (t[1:] == t[:-1]))
    heads = np.flatnonzero(~goes_on)
    last = last[np.append(heads[1:], len(t)) - 1]
    t, h, q, first = t[heads], h[heads], q[heads], first[heads]
    return t, h, q - start[t], first - start[t], last - start[t]


def text_key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


# --- 1. anchors that occur again ---

def _anchor_batch(width: int):
    """A row for each anchor of a batch of different texts: anchor, key, ordinal, sure.

    Anchors of a text that has copies, and those that the batch holds twice, are known to be
    repeated. One row without a key stands for them in the count, and their places go on as `sure`
    under a name that spreads them. So an anchor in a large share of all texts is one row a batch.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t, h, *_ = anchors(null_safe_bytes(batch.column(1)), width)
        if not len(t):
            return None
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
        copied = (batch.column(2).to_numpy(zero_copy_only=False) > 1)[t]
        ordinal = np.arange(len(t)) - np.searchsorted(t, t)
        different, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        known = counts > 1
        known[which[copied]] = True
        sure = known[which]
        spread = h + np.arange(len(h)) * np.int64(0x1E3779B97F4A7C15)
        goes = ~copied  # a copied text is taken whole
        several = different[known]
        name = np.append(np.where(sure, spread, h)[goes], several)
        n = int(goes.sum())
        held = np.append(keys[t[goes]], np.zeros(len(several), "V16"))
        offsets = np.arange(len(held) + 1, dtype=np.int32) * 16
        valid = np.packbits(np.arange(len(held)) < n, bitorder="little")
        binary = pa.Array.from_buffers(pa.binary(), len(held), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(held.tobytes())])
        columns = [pa.array(name), binary, pa.array(np.append(ordinal[goes], np.zeros(len(several))).astype(np.int32)), pa.array(np.append(sure[goes], np.zeros(len(several), bool)))]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "key", "ordinal", "sure"])

    return kernel


def repeated_anchors(texts: DataFrame, width: int) -> DataFrame:
    """key, ordinals of those of the different texts (key, text, copies) that hold anchors which occur again; a row for each place on the way."""
    rows = map_arrow(texts, _anchor_batch(width), "anchor long, key binary, ordinal int, sure boolean", TEXT_BYTES)
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    places = counted.where(F.col("key").isNotNull() & (F.col("sure") | (F.col("n") > 1)))
    return places.groupBy("key").agg(F.collect_list("ordinal").alias("ordinals"))


# --- 2. contexts ---

CONTEXTS = "route long, back int, shift int, context binary, id binary, n long"


def _context_batch(width: int):
    """The contexts of the repeated anchors of a batch, equal ones as one, with all their places. Without ordinals all anchors count."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, texts, wanted, copies = batch.column(0).to_pylist(), null_safe_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        t, h, q, first, last = anchors(texts, width)
        base = np.searchsorted(t, np.arange(len(texts)))
        sizes = np.bincount(t, minlength=len(texts)).tolist()
        picked = np.concatenate([(np.arange(n) if w is None else np.sort(np.array(w, np.int64))) + b for w, b, n in zip(wanted, base.tolist(), sizes, strict=True)])
        found: dict[tuple[int, int, bytes], tuple[list[bytes], list[int], list[int]]] = {}
        for k, route, anchor, a, b in zip(*(x[picked].tolist() for x in (t, h, q, first, last)), strict=True):
            at = found.setdefault((route, anchor - a, texts[k][a : b + width]), ([], [], []))
            at[0].append(keys[k])
            at[1].append(a)
            at[2].append(copies[k])
        if not found:
            return None
        routes, backs, contexts = zip(*found, strict=True)
        ids = [hashlib.blake2b(c + b.to_bytes(4, "little"), digest_size=16).digest() for c, b in zip(contexts, backs, strict=True)]
        columns = [pa.array(routes, pa.int64()), pa.array(backs, pa.int32()), pa.array(np.zeros(len(ids), np.int32)), pa.array(contexts, pa.binary()), pa.array(ids, pa.binary()), pa.array([sum(x[2]) for x in found.values()], pa.int64()), pa.array([x[0] for x in found.values()], pa.list_(pa.binary())), pa.array([x[1] for x in found.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["route", "back", "shift", "context", "id", "n", "keys", "starts"])

    return kernel


def halves(size: int, width: int):
    """Splits contexts by blocks of `size` distances from the anchor, each routed by the bytes all its windows share."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = [[] for _ in range(6)]
        for route, back, shift, context, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            windows = len(context) - width + 1
            for block in range((back - windows + 1) // size, back // size + 1):
                far, near = min(back, block * size + size - 1), max(back - windows + 1, block * size)
                core = context[back - block * size : back - block * size - size + 1 + width]
                name = hashlib.blake2b(core, digest_size=8, key=f"{route}:{block}".encode()).digest()
                row = (int.from_bytes(name, "little", signed=True), far, shift + back - far, context[back - far : back - near + width], key, n)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["route", "back", "shift", "context", "id", "n"])

    return kernel


# --- 3. suffix arrays ---


def _judge(width: int, shard_bytes: int):
    """Repeated runs (id, shift, starts, lengths) of contexts that come sorted by route, shard by shard."""

    columns = ("id", "shift", "starts", "lengths")
    kinds = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def flush(routes: list[dict[bytes, list]]) -> pa.RecordBatch | None:
        """routes: for each, by context, its number and the (id, shift) of those that hold it."""
        several = [c for held in routes if len(held) > 1 for c in held]
        flags = iter(repeated_windows(several, width) if several else [])
        out = [[], [], [], []]
        for held in routes:
            for context, (n, *places) in held.items():
                windows = len(context) - width + 1
                # the windows of one context differ, as they lie at different distances from one anchor
                flag = next(flags) if len(held) > 1 else None
                if n > 1:
                    runs = [0], [windows]
                elif flag is None:
                    continue
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], flag, [0])).astype(np.int8)))
                    runs = edges[::2], edges[1::2] - edges[::2]
                if len(runs[0]):
                    for key, shift in dict.fromkeys(places):
                        for column, value in zip(out, (key, shift, *runs), strict=True):
                            column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], columns) if out[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, held, route = [], 0, None
        for batch in batches:
            for r, context, key, shift, n in zip(*(batch.column(c).to_pylist() for c in ("route", "context", "id", "shift", "n")), strict=True):
                if r != route or not routes:
                    if held >= shard_bytes:
                        if (out := flush(routes)) is not None:
                            yield out
                        routes, held = [], 0
                    routes.append({})
                    route = r
                at = routes[-1].setdefault(context, [0])
                at[0] += n
                at.append((key, shift))
                held += len(context)
        if routes and (out := flush(routes)) is not None:
            yield out

    return run


def _judged(contexts: DataFrame, width: int) -> DataFrame:
    """Repeated runs of contexts. Rows of one id and shift are one, with the sum of their n, before they go to the route's task."""
    once = contexts.groupBy("route", "id", "shift", "context").agg(F.sum("n").alias("n"))
    return once.repartition("route").sortWithinPartitions("route").mapInArrow(_judge(width, SHARD_BYTES), "id binary, shift int, starts array<int>, lengths array<int>")


def _judged_once(split: DataFrame, width: int) -> DataFrame:
    """Repeated runs of split contexts. Equal strings of a route are judged once, and the verdict is joined to all that hold them.

    The contexts of a very common passage differ but hold the same windows: their rows are as many as its texts.
    """
    named = split.withColumn("string", F.substring(F.unhex(F.sha2("context", 256)), 1, 16))
    different = named.groupBy("route", "string", "context").agg(F.sum("n").alias("n"))
    # a string's name holds its route, so a verdict is of one route
    name = F.concat(F.unhex(F.lpad(F.hex("route"), 16, "0")), F.col("string"))
    judged = _judged(different.select("route", name.alias("id"), F.lit(0).alias("shift"), "context", "n"), width).withColumnRenamed("shift", "_none")
    verdicts = materialise(judged.withColumnRenamed("id", "name").drop("_none"), "verdicts")
    held = named.select("id", "shift", name.alias("name")).distinct()
    return held.join(verdicts, "name").select("id", "shift", "starts", "lengths")


def _large(contexts: DataFrame, limit: int) -> DataFrame:
    """Routes with more than `limit` different contexts."""
    return materialise(contexts.select("route", "id", "shift").distinct().groupBy("route").count().where(F.col("count") > limit).select("route"), "large_routes")


def repeated_runs(contexts: DataFrame, width: int, limit: int = MAX_CONTEXTS) -> DataFrame:
    """id, shift, starts, lengths of the repeated windows of all contexts."""
    large = _large(contexts, limit)
    if large.isEmpty():
        return _judged(contexts, width)
    done = [_judged(contexts.join(large, "route", "left_anti"), width)]
    size = width // 2
    while True:
        split = map_arrow(contexts.join(large, "route", "left_semi").select("route", "back", "shift", "context", "id", "n"), halves(size, width), CONTEXTS)
        # a route of single windows has one string, whatever the number of its rows
        split = materialise(split, "split_contexts")
        large = _large_bytes(split, limit)
        if size == 1 or large.isEmpty():
            done.append(_judged_once(split, width))
            break
        done.append(_judged_once(split.join(large, "route", "left_anti"), width))
        contexts, size = split, -(-size // 2)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _large_bytes(contexts: DataFrame, limit: int) -> DataFrame:
    """Routes with more than `limit` different strings of bytes."""
    return materialise(contexts.select("route", F.xxhash64("context").alias("c")).distinct().groupBy("route").count().where(F.col("count") > limit).select("route"), "large_routes")


# --- 4. removal ---


def cover(length: int, starts: list[int], lengths: list[int], width: int) -> np.ndarray:
    """True for each byte in a repeated window."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, np.array(starts, np.int64), 1)
    np.add.at(change, np.array(starts, np.int64) + np.array(lengths, np.int64) - 1 + width, -1)
    return np.cumsum(change[:-1]) > 0


def runs_by_text(docs: DataFrame, width: int = WIDTH, max_contexts: int = MAX_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(key, text of the texts that may lose bytes; key, starts, lengths of their repeated windows).

    Equal texts are one, with their number, before anything else: partial aggregation leaves one
    in a task, so the copies of a common text do not meet. The exchange that brings them together is
    used again where the repeated anchors are joined.
    """
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").where(F.octet_length("text") >= width)
    different = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    flags = repeated_anchors(different, width)
    held = different.join(flags, "key", "left").where(F.col("ordinals").isNotNull() | (F.col("copies") > 1))
    held = materialise(held.select("key", "text", "ordinals", "copies"), "repeated_texts")
    schema = f"{CONTEXTS}, keys array<binary>, starts array<long>"
    contexts = materialise(map_arrow(held, _context_batch(width), schema, TEXT_BYTES), "contexts")
    judged = repeated_runs(contexts.drop("keys", "starts"), width, max_contexts)
    # a context's places stay the arrays of a batch until its runs are known, so those of a common one are a row a batch
    places = contexts.select("id", F.arrays_zip(F.col("keys").alias("key"), F.col("starts").alias("at")).alias("places"))
    held_runs = places.join(judged, "id").select(F.explode("places").alias("p"), "shift", "starts", "lengths")
    runs = held_runs.select("p.key", F.transform("starts", lambda s: s + F.col("p.at") + F.col("shift")).alias("starts"), "lengths")
    by_text = runs.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"))
    return held.select("key", "text"), by_text


def removals(docs: DataFrame, width: int = WIDTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """key, n_removed, n_spans, kept (the bytes left) of each different text that loses bytes."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, spans, kept = [], [], []
        for text, starts, lengths in zip(null_safe_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            gone = cover(len(text), starts, lengths, width)
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    texts, runs = runs_by_text(docs, width, max_contexts)
    return map_arrow(texts.join(runs, "key"), kernel, "key binary, n_removed long, n_spans long, kept binary", TEXT_BYTES)


def deduplicate(docs: DataFrame, width: int = WIDTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    made = removals(docs, width, max_contexts).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    joined = rows.join(materialise(made, "removals"), "key", "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """The documents without their repeated bytes; n_chars, where there is one, follows."""

    def valid(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()], pa.string())], ["_key", "_left"])

    made = removals(docs, width, max_contexts).select("key", "kept")
    made = materialise(map_arrow(made, valid, "_key binary, _left string"), "kept_texts")
    # columns by their frame, as docs may have any names
    text = F.coalesce(made["_left"], docs["text"])
    new = {"text": text, "n_chars": F.length(text)}
    joined = docs.join(made, text_key(docs["text"]) == made["_key"], "left")
    return joined.select(*(new[f.name].cast(f.dataType).alias(f.name) if f.name in new else docs[f.name] for f in docs.schema))
