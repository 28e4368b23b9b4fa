"""Phrase collocations, mined with hashed bucket counts (PCY, and DHP for lengths over two).

One pass over the texts for each length n. It counts the phrases of n words exactly, but only those
that may be frequent: whose bucket was full in the pass before, and whose two parts of n - 1 words
are frequent (Apriori). The same pass counts the phrases of n + 1 words into hashed buckets, where
both their parts are still in the running. Buckets stop at min_count and merge by addition over
tasks; what is broadcast is one bit a bucket, of full buckets and of the buckets of frequent phrases.
A filter depends on the phrase alone, so all occurrences of a phrase are counted or none, and none is
lost that occurs min_count times: counts are exact.

Buckets grow with the bytes of the texts up to 2 ** MAX_BITS (64 MB of counts in a task, 8 MB of
bits broadcast); beyond that bits leave out less, and results stay the same.

Words are what blanks and tabs part within pieces, which `.,;:!?` and line ends part; A-Z count as
a-z. Everything is by language, null being `und`. Null and empty texts have no words; repeated rows
count again; an empty table gives an empty result; columns other than text and lang are ignored.
Ties in score go by count and then by phrase, in the order of its UTF-8 bytes.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, passing, slices

#: Bounds of the number of buckets, as powers of two, and the bytes of text for a bucket.
MIN_BITS, MAX_BITS, BUCKET_BYTES = 16, 26, 64
#: Buckets in a row of a table of counts, at most.
BLOCK = 1 << 16
#: Shares of a language that are ranked apart before its phrases are.
SHARES = 64
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: ASCII bytes: letters in lower case, separators as line ends, tabs as blanks.
BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in SEPARATORS else 32 if c == 9 else c for c in range(256))
BREAK = -1
RAW = "lang string, phrase string, c long, block int, counts binary"
SCORE = 1_000_000


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words, and the number of each word in order, with BREAK between pieces."""
    numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
    numbers[b""], numbers[b"\n"]
    parts = b"\n".join(texts).translate(BYTES).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts))
    return list(numbers)[2:], ids[ids > 0] - 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def bucket_of(lang: str, parts: list[np.ndarray], bits: int) -> np.ndarray:
    """The bucket of each phrase: parts are the hashes of its first words, second words and so on."""
    x = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang, len(parts)), np.uint64)
    for part in parts:
        x = (x ^ part) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


class Buckets:
    """Counts that stop at `full`."""

    def __init__(self, bits: int, full: int):
        self.bits, self.full = bits, full
        self.counts = np.zeros(1 << bits, np.uint8 if full < 256 else np.uint32)

    def add(self, buckets: np.ndarray) -> None:
        which, n = np.unique(buckets, return_counts=True)
        self.counts[which] = np.minimum(self.counts[which] + n, self.full)

    def blocks(self) -> Iterator[pa.RecordBatch]:
        size = min(BLOCK, len(self.counts))
        for at in range(0, len(self.counts), size):
            if (part := self.counts[at : at + size]).any():
                yield _rows(None, [None], [None], at // size, zlib.compress(part.tobytes(), 1))


def _rows(lang: str | None, phrases: list, c: list | np.ndarray, block: int | None = None, counts: bytes | None = None) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array([block] * n, pa.int32()), pa.array([counts] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "c", "block", "counts"])


def has_bit(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)


def _distinct(ids: np.ndarray, at: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first of each different phrase of n words that starts at one of `at`, and their numbers."""
    code = ids[at]
    for k in range(1, n):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * n_words + ids[at + k]
    _, first, c = np.unique(code, return_index=True, return_counts=True)
    return at[first], c


def count_texts(texts: list[bytes], lang: str, n: int, full: np.ndarray | None, parts: np.ndarray | None, bits: int, longer: Buckets | None) -> pa.RecordBatch | None:
    """Rows of the phrases of n words that may be frequent; adds those of n + 1 words that may to the buckets."""
    words, ids = words_of(texts)
    whole = np.concatenate([ids, np.full(n, BREAK)])
    ok = ids >= 0  # phrases that start here have no break within and may be frequent
    for k in range(1, n):
        ok &= whole[k : k + len(ids)] >= 0
    h = word_hashes(words)
    at = np.flatnonzero(ok)
    if full is not None:
        at = at[has_bit(parts, bucket_of(lang, [h[ids[at + k]] for k in range(n - 1)], bits))]
        at = at[has_bit(parts, bucket_of(lang, [h[ids[at + k]] for k in range(1, n)], bits))]
        at = at[has_bit(full, bucket_of(lang, [h[ids[at + k]] for k in range(n)], bits))]
    if not len(at):
        return None
    if longer is not None:
        ok = np.zeros(len(ids) + 1, bool)
        ok[at] = True
        both = at[ok[at + 1]]
        longer.add(bucket_of(lang, [h[ids[both + k]] for k in range(n + 1)], longer.bits))
    first, c = _distinct(ids, at, n, len(words))
    columns = [map(words.__getitem__, ids[first + k].tolist()) for k in range(n)]
    return _rows(lang, list(map(b" ".join, zip(*columns, strict=True))), c)


def _pass(docs: DataFrame, n: int, bits: int, min_count: int, full: np.ndarray | None, parts: np.ndarray | None, last: bool) -> DataFrame:
    """Rows of RAW: counts of phrases of n words in slices of texts, and blocks of bucket counts of those of n + 1."""
    sent = docs.sparkSession.sparkContext.broadcast((full, parts))

    def run(batches):
        longer = None if last else Buckets(bits, min_count)
        for batch in slices(batches):
            langs = batch.column(1).to_pylist()
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), langs, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                found = count_texts(texts, lang, n, *sent.value, bits, longer)
                if found is not None:
                    yield found
        if longer is not None:
            yield from longer.blocks()

    return docs.mapInArrow(run, RAW)


def _merged(blocks: DataFrame, full: int) -> DataFrame:
    """block, bits: which buckets are full when equal blocks are added. A task holds one at a time."""
    kind = np.uint8 if full < 256 else np.uint32

    def packed(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= full, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    def run(batches):
        block, total = None, None
        for batch in batches:
            for at, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "counts")), strict=True):
                part = np.frombuffer(zlib.decompress(counts), kind)
                if at == block:
                    total = np.minimum(total.astype(np.int64) + part, full).astype(kind)
                    continue
                if block is not None:
                    yield packed(block, total)
                block, total = at, part
        if block is not None:
            yield packed(block, total)

    return blocks.select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")


def bitmap(raw: DataFrame, bits: int, full: int) -> np.ndarray:
    """One bit for each full bucket: 2 ** bits / 8 bytes."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = min(BLOCK, 1 << bits) // 8
    for row in _merged(raw.where("block IS NOT NULL"), full).collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _marked(frequent: DataFrame, n: int, bits: int) -> np.ndarray:
    """The bitmap of the buckets of frequent phrases of n words."""

    def run(batches):
        marks = Buckets(bits, 1)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                columns = zip(*(p.split(b" ") for p in phrases), strict=True)
                marks.add(bucket_of(lang, [word_hashes(list(c)) for c in columns], bits))
        yield from marks.blocks()

    return bitmap(frequent.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, RAW), bits, 1)


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, bits: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the words of each language, and (lang, phrase, c) of the phrases of 1, 2, ... words that occur min_count times."""
    x = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    if bits is None:
        size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(MIN_BITS, min(MAX_BITS, math.ceil(math.log2(max(1, size / BUCKET_BYTES)))))
    full = parts = totals = None
    found: list[DataFrame] = []
    for n in range(1, max_words + 1):
        with passing(_pass(x, n, bits, min_count, full, parts, n == max_words), f"phrases{n}") as raw:
            rows = raw.where("block IS NULL")
            if n == 1:
                totals = materialise(rows.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
            found.append(materialise(rows.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count), f"frequent{n}"))
            if n < max_words:
                full, parts = bitmap(raw, bits, min_count), _marked(found[-1], n, bits)
    return totals, found


def _within(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start + 1, size), " ")


def cuts(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut. Exact: products are decimals of 38 digits."""
    sides, wanted = None, None
    for n in range(2, len(found) + 1):
        words = F.split("phrase", " ")
        sub = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _within(words, start, size).alias("sub")) for k in range(1, n) for side, start, size in (("l", 0, k), ("r", k, n - k))]
        rows = found[n - 1].select("lang", "phrase", F.col("c").alias("a"), F.inline(F.array(*sub)))
        sides = rows if sides is None else sides.unionByName(rows)
        part = found[n - 2].select("lang", F.col("phrase").alias("sub"), F.col("c").alias("f"))
        wanted = part if wanted is None else wanted.unionByName(part)
    by_cut = sides.join(wanted, ["lang", "sub"]).groupBy("lang", "phrase", "a")
    values = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in range(1, len(found)) for side in ("l", "r")]
    exact = lambda c: f"cast({c} AS decimal(15, 0))"
    best = None
    for k in range(1, len(found)):
        score = F.expr(f"cast({exact('a')} * {exact('a')} * cast({SCORE} AS decimal(7, 0)) div ({exact(f'l{k}')} * {exact(f'r{k}')}) AS long)")
        one = F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        best = one if best is None else F.least(best, one)
    return by_cut.agg(*values).select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, covered_percent: int = 50, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    Phrases within a longer frequent one that makes up covered_percent of them are left out.
    """
    totals, found = frequent_phrases(docs, max_words, min_count, bits)
    longer = None
    for n in range(3, max_words + 1):
        words = F.split("phrase", " ")
        inner = F.array(*(_within(words, start, size) for size in range(2, n) for start in range(n - size + 1)))
        rows = found[n - 1].select("lang", F.explode(inner).alias("phrase"), "c")
        longer = rows if longer is None else longer.unionByName(rows)
    x = cuts(found)
    if longer is not None:
        x = x.join(longer.groupBy("lang", "phrase").agg(F.max("c").alias("most")), ["lang", "phrase"], "left").where((100 * F.coalesce("most", F.lit(0))) < covered_percent * F.col("a"))
    # the best of each share of a language, then the best of those
    x = x.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    for keys in (("lang", "share"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        x = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    x = x.join(totals, "lang")
    return x.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: mine() in SQL.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
p AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM s),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS p1, array_to_string(ws[cut + 1:], ' ') AS p2 FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
v AS (SELECT u.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM u
  JOIN g x ON x.lang = u.lang AND x.phrase = p1 AND x.k = cut JOIN g y ON y.lang = u.lang AND y.phrase = p2 AND y.k = u.k - cut),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE 100 * coalesce(most, 0) < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
