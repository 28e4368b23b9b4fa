import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SINGLE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, hash int"
ROWS = [
    (1, "The first text, it's short.", "en", 1),
    (2, None, None, None),
    (3, "", "en", 2),
    (4, "  lines\n\n and  'll  ä ß 中文 " * 900, "de", 3),
    (4, "  lines\n\n and  'll  ä ß 中文 " * 900, "de", 3),
    (None, "no id", None, 5),
    (6, "x" * 3000 + " y" * 2000, "en", 6),
    (7, "<|endoftext|> is ordinary", "en", 7),
]


def expected(vocab, text):
    ids = vocab.encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'ll", "'", "é", "1", "!!", "\t", "中"]), max_size=120), st.sampled_from([5, 16, 40]), st.sampled_from([5, 8, 20]))
def test_chunks_agree_with_whole_text(parts, chunk, overlap):
    vocab, text = bpe.vocabulary(MULTI), "".join(parts)
    ids = bpe.encode_chunked(vocab, text, chunk, overlap)
    assert ids == vocab.encoding.encode_ordinary(text)
    assert vocab.decode(ids) == text.encode()


@pytest.mark.parametrize("run", [0, 900, 5000])
def test_a_long_match_costs_no_other_cut(run):
    """17 chunks of prose, with one run of letters over the first cut."""
    vocab, rng = bpe.vocabulary(MULTI), random.Random(run)
    prose = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(7000))[: 17 * 2048]
    text = prose[:2000] + "x" * run + prose[2000:]
    spans = bpe.chunk_spans(vocab, text, 2048, 128)
    pieces = bpe.stitch([bpe.chunk_edges(vocab, text[a:b], a, head, tail, b == len(text)) for a, b, head, tail in spans])
    assert sum(cut >= 0 for _, cut in pieces) >= 15 and all(host == i for i, (host, _) in enumerate(pieces))
    assert bpe.encode_chunked(vocab, text, 2048, 128) == vocab.encoding.encode_ordinary(text)


def test_text_without_boundaries():
    vocab, text = bpe.vocabulary(MULTI), "中" * 5000
    assert len(bpe.chunk_spans(vocab, text, 256, 32)) == 1
    assert bpe.encode_chunked(vocab, text, 256, 32) == vocab.encoding.encode_ordinary(text)


@pytest.mark.parametrize("chunk", [64, 1 << 15])
def test_documents(spark, chunk):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    vocab = bpe.vocabulary(MULTI)
    got = sorted(map(tuple, bpe.encode_documents(docs, MULTI, chunk, 16).collect()), key=str)
    assert got == sorted(((r[0], *expected(vocab, r[1])) for r in ROWS), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_documents(docs, MULTI).count() == 0
    assert packing.pack_documents(docs, SINGLE).count() == 0


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA), SINGLE).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    check_packing(rows, 2048)


def test_libraries_agree_on_every_code_point():
    """Splits and ids of the rank files, the split pattern and the tokenizer file."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    single, multi = bpe.vocabulary(SINGLE), bpe.vocabulary(MULTI)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} .{chr(c)}!{chr(c)}" for c in points[at : at + 4000])
        ids = single.encode(text)
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids
        ends = [0, *single.boundaries(text)]
        assert [i for a, b in zip(ends, ends[1:], strict=False) for i in single.encode(text[a:b])] == ids
        assert multi.decode(multi.encode(text)) == text.encode()


def test_cut():
    assert packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)]
    assert packing.cut(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("seed", range(3))
def test_exchange_meets_the_bound(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(300, 1200)]) for _ in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    packed = packing.pack(parts, 2048, partition_pieces=400)
    rows = packed.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    used = check_packing(rows, 2048)
    assert packing.certificate(packed, 2048)[0] == used
    assert used <= packing.certificate(packed, 2048)[1] + 3


def test_small_partitions_go_on_until_one_is_left(spark):
    """Partitions of 20 pieces: whatever the number of rounds, all pieces have a place and none is lost to the exchange."""
    rng = random.Random(7)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(300, 1200), 2048]) for _ in range(900)]
    parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(parts, 2048, partition_pieces=20).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    used = check_packing(rows, 2048)
    assert used <= packing.certified([(n, 1) for n in lengths], 2048) * 1.1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_is_one(lengths):
    """No packing has fewer bins than the bound: compared with an exhaustive search."""

    def best(items, bins):
        if not items:
            return len(bins)
        out = best(items[1:], [*bins, items[0]])
        for i, b in enumerate(bins):
            if b + items[0] <= 20 and b not in bins[:i]:
                out = min(out, best(items[1:], [*bins[:i], b + items[0], *bins[i + 1 :]]))
        return out

    lengths = sorted(lengths, reverse=True)[:7]
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= best(lengths, [])
