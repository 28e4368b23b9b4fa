import hashlib
import random
import zlib

import pytest

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = (*own.get(c - c % 100, [])[:h], *own[c][h:])
    nodes = {}
    for c, turns in sorted(made.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = {q: m for q, m in nodes.items() if q[: len(p)] == p}
        children = {q for q in below if len(q) == len(p) + 1}
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(m) - 1) * len(q[-1][1]) for q, m in below.items() if q)
        ends = ",".join(str(c) for c in members if len(made[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_dictionaries_of_prefixes(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 25), *range(100, 130), *range(205, 215), 300]:
        for turn in range(r.choice((1, 2, 4, 7))):
            rows.append((c, r.choice((turn, turn, None)), r.choice(("user", None, "user:")), r.choice(("a", "a", "é😀", None, f"own {c}"))))
    rows += [(None, 1, "user", "a"), rows[3], (300, 0, "x", "y")]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_copies_blocks_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)  # members and chains over several blocks
    rows = [(c, t, "user", f"same {t}") for c in range(150) for t in range(3)] + [(10_050, t, "user", "x" * t) for t in range(70)]
    docs = spark.createDataFrame([(*x, 1, "p") for x in rows], f"{SCHEMA}, node long, parent string")
    assert got(trie.prefix_trie(docs)) == brute(rows)


def test_edges(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    for rows in ([(7, None, None, None)], [(100, 1, "a", "b")], [(100, 1, "a", "b"), (100, 1, "a", "b")]):
        assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
