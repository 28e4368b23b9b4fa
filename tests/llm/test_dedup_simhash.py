import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import dedup, simhash
from tessera.llm.suffix import END, repeated_windows, suffix_array

SCHEMA = "doc_id long, text string, key string, n_chars long"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([1, 70]))
def test_suffix_array(symbols, spread):
    s = np.array([x * spread for x in symbols] + [END], np.uint16)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=30).map(str.encode), min_size=1, max_size=5), st.sampled_from([1, 3, 6]))
def test_repeated_windows(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for text, got in zip(texts, repeated_windows(texts, width), strict=True):
        assert got.tolist() == [seen[text[i : i + width]] > 1 for i in range(len(text) - width + 1)]


def brute_removal(rows, width):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeäß") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copied = prose(70), prose(150)
    rows = [(i, f"{prose(rng.randint(0, 80))} {passage} {prose(rng.randint(0, 40))}", "k", 1) for i in range(30)]
    rows += [(100 + i, copied, "k", 1) for i in range(12)]
    rows += [(200 + i, copied[: rng.randint(150, 700)] + prose(30), "k", 1) for i in range(12)]
    rows += [(300, None, None, None), (301, "", "k", 0), (None, prose(60), "k", 2), (302, "=" * 900, "k", 3), (303, "ab " * 400, "k", 3), (304, "ab " * 90, "k", 3), (305, prose(9000), "k", 3)]
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_removal_is_exact(spark, limit):
    rows = corpus(limit)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").coalesce(2)
    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    got = sorted((tuple(r) for r in dedup.deduplicate(docs, max_contexts=limit).collect()), key=str)
    assert got == brute_removal(rows, 200)


def test_removed_texts_stay_valid(spark):
    rows = corpus(1)
    out = dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "key", "n_chars"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[300]["text"] is None and got[100]["text"] == "" and got[100]["n_chars"] == 0
    assert got[305]["text"] == rows[-1][1]


def test_dedup_of_nothing(spark):
    assert dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 3000))) for _ in range(20)]
    whole = [x.tolist() for x in dedup.anchors(texts)]
    monkeypatch.setattr(dedup, "BLOCK", 517)
    assert [x.tolist() for x in dedup.anchors(texts)] == whole
    alone = [x for t in texts for x in dedup.anchors([t])[1].tolist()]
    assert alone == whole[1]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 99)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{rng.randint(0, 9)}"] + base[k + 1 :]), "k", 1) for i, k in enumerate(rng.sample(range(400), 40))]
    rows += [(100, "One TWO three", "k", 1), (101, "one two  three", "k", 1), (102, "Één x", "k", 1), (103, None, None, None), (104, " \n", "k", 1), (105, "two words", "k", 1)]
    want = {r[0]: brute_fingerprint(r[1]) for r in rows}
    roots = groups(want)
    for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", roots[r["doc_id"]])
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(roots.values())


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_connect_all_near_fingerprints(spark, bucket):
    rng = random.Random(7)
    values = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            values.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    signed = [simhash._signed(v) for v in values]
    fps = spark.createDataFrame([(v, v) for v in signed], "fp long, first long")
    want = groups({s: s & (1 << 64) - 1 for s in signed})
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, bucket)).collect()}
    assert {s: got.get(s, s) for s in signed} == want


def test_simhash_edge_rows(spark):
    rows = [(1, "a b c d", "k", 1), (1, "a b c d", "k", 1), (None, "a b c d", "k", 1), (2, "quite another text it is", "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2)], key=str)
    assert sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=str) == [1, 2, None]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
