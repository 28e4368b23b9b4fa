import random

import numpy as np
import pytest

from tessera.llm import similar, simhash

SCHEMA = "doc_id long, text string, _row string"


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randint(0, 10**9)}"
    return out


def corpus(seed, families=120):
    """Texts at all similarities from 0.6 on, with copies, short and empty ones."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 120, 400]))]
        rows += [" ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(rng.randint(1, 5))]
    rows += ["one two", "One  TWO", "", None, " \n"]
    rng.shuffle(rows)
    return [(i, t, "x") for i, t in enumerate(rows)]


def brute(rows, words=5, least=0.8):
    """Root of each row, and the number of pairs that are linked, by comparing all."""
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), words).tolist()) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_stage_keeps_one_of_similar_texts(spark):
    """The pipeline's stage against brute force over all pairs at five words and 0.8."""
    import corpus_pipeline

    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute(rows)))


def test_bands_find_pairs_at_the_limit():
    """Recall of candidates and of the sketch's limit at a similarity of just 0.8, over 2,000 pairs."""
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(2000):
        x = np.unique(rng.integers(1 << 63, size=450, dtype=np.uint64))
        pairs += [x[:405], x[45:]]  # 360 of 450 in common
    assert all(similar.is_similar(a, b, 0.8) for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    values = similar.signatures(pairs)
    keys = similar.band_keys(values)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    agree = (values[::2, :96] & np.uint64(15) == values[1::2, :96] & np.uint64(15)).sum(axis=1)
    assert met.mean() >= 0.998 and (agree >= similar.least_agreement(0.8)).all()


def test_pairs_across_groups_are_compared(spark):
    """A chain of edits: its ends are below the limit, and every link between must be found from within the buckets."""
    rng = random.Random(2)
    chain = [[f"w{i}" for i in range(400)]]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 6))
    rows = [(i, " ".join(w), "x") for i, w in enumerate(chain)]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), words=5, similarity=0.8)
    assert [r["doc_id"] for r in out.collect()] == [0]


def test_edge_cases(spark):
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA), 5, 0.8).count() == 0
    rows = [(None, "a b c d e f", "x"), (4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (None, None, "x")]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), 5, 0.8).collect()) == ["4", "None", "None"]
    with pytest.raises(ValueError):
        simhash.keep_one(spark.createDataFrame(rows, SCHEMA), 5, 0.5)


def test_rows_of_one_id_with_different_texts_stay(spark):
    rows = [(7, "the first of two texts that have one id", "x"), (7, "nothing here is like that other row at all", "x")]
    assert simhash.keep_one(spark.createDataFrame(rows, SCHEMA), 5, 0.8).count() == 2


def pairs_of(rng, size, similarity, n):
    """Pairs of sets of this size and similarity, with members of all hashes in each part."""
    both = round(2 * size * similarity / (1 + similarity))
    for _ in range(n):
        x = rng.permutation(np.unique(rng.integers(1 << 63, size=2 * size - both, dtype=np.uint64)))
        yield np.sort(x[:size]), np.sort(np.r_[x[:both], x[size:]])


def test_fingerprints_find_pairs_at_the_limit():
    """Recall of the pipeline's candidates and of its radius over 2,000 pairs at 0.8, large and small; pairs at 0.2 seldom meet."""
    rng = np.random.default_rng(5)

    def met(pairs):
        views = simhash.weighted_fingerprints([x for p in pairs for x in p])
        differ = views[::2] ^ views[1::2]
        equal = sum((differ >> np.uint64(low) & np.uint64((1 << high - low) - 1)) == 0 for low, high in simhash.BLOCKS)
        return (equal >= 4).any(axis=1).mean()

    for size in (27, 135):
        pairs = list(pairs_of(rng, size, 0.8, 2000))
        assert met(pairs) >= 0.998
        assert max((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a, b in pairs) <= simhash.radius_of(0.8)
    assert met(list(pairs_of(rng, 135, 0.2, 500))) < 0.1


def test_sets_meet_at_pivot_coordinates(spark):
    """Sets share a key where four blocks of a view are equal, and not where three are."""
    low = [b[0] for b in simhash.BLOCKS]
    views = [[k * 0x0123456789ABCDF % (1 << 62) for k in range(1, simhash.VIEWS + 1)] for _ in range(3)]
    views[1] = [v ^ (1 << low[1]) ^ (3 << low[2] if i else 0) for i, v in enumerate(views[0])]
    views[2] = [v ^ (1 << low[3]) ^ (1 << low[4]) for v in views[0]]
    places = simhash.meeting_places(spark.createDataFrame(list(enumerate(views)), "node long, views array<long>"))
    keys = [{r["key"] for r in places.where(f"node = {n}").collect()} for n in range(3)]
    assert [len(k) for k in keys] == [5 * simhash.VIEWS] * 3
    assert len(keys[0] & keys[1]) == 1 and not keys[0] & keys[2]
