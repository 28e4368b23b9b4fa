import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, max_words=3, min_count=10, top=2000, percent=50):
    """All phrases, counted in dictionaries."""
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, max_words + 1):
                counts.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    total = Counter()
    for (lang, p), c in counts.items():
        total[lang] += c * (len(p) == 1)
    good = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= min_count}
    dropped = set()
    for (lang, p), c in good.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * c >= percent * counts[lang, p[i : i + size]]:
                    dropped.add((lang, p[i : i + size]))
    out = []
    for (lang, p), a in good.items():
        if (lang, p) not in dropped:
            score, _, l, r = min((1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r, total[lang]))
    ranked, last, rank = [], None, 0
    for lang, s, a, p, l, r, n in sorted(out):
        rank = 1 if lang != last else rank + 1
        last = lang
        if rank <= top:
            ranked.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return ranked


def corpus(seed, n=150):
    random.seed(seed)
    words = ["Alpha", "beta", "Ünder", "gamma", "delta", "eps", "ÉTÉ", "x1", "a b", "z　"] + [f"rare{i}" for i in range(60)]
    rows = []
    for i in range(n):
        parts = [random.choice(words[: random.choice((4, 10, 70))]) + random.choice((" ", " ", "\t ", "  ", ". ", ",", "\n", "\r\n", "; ")) for _ in range(random.randint(0, 120))]
        rows.append((i, "".join(parts), random.choice(("en", "de", None, "und", "en"))))
    return [*rows, (900, None, "en"), (901, "", None), (None, "alpha beta " * 4000, "en"), rows[0], rows[0]]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "min_count": 3}, {"max_words": 2, "min_count": 300}, {"top": 7, "covered_percent": 80}, {"bits": 8}])
def test_equal_to_counting_everything(spark, options):
    rows = corpus(len(options))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, options.get("max_words", 3), options.get("min_count", 10), options.get("top", 2000), options.get("covered_percent", 50))
    assert got(phrases.mine(docs, **options)) == sorted(want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, "x", "y")], "doc_id long, text string, lang string, phrase string, block string")
    assert phrases.mine(docs).collect() == [] and phrases.mine(docs.limit(0)).collect() == []
    # products over 64 bits
    found = [spark.createDataFrame(r, "lang string, phrase string, c long") for r in ([("en", "a", 10**13), ("en", "b", 10**13 - 1)], [("en", "a b", 10**13 - 2)])]
    a, l, r = 10**13 - 2, 10**13, 10**13 - 1
    assert got(phrases.cuts(found)) == [("en", "a b", a, l, r, 1_000_000 * a * a // (l * r))]


def test_buckets_merge_and_no_frequent_phrase_is_lost(spark):
    texts = [" ".join(f"w{random.Random(i * j).randint(0, 30)}" for j in range(200)).encode() for i in range(40)]
    whole, halves = phrases.Buckets(10, 10), [phrases.Buckets(10, 10) for _ in range(2)]
    phrases.count_texts(texts, "en", 1, None, None, 10, whole)
    for i, b in enumerate(halves):
        phrases.count_texts(texts[i::2], "en", 1, None, None, 10, b)
    table = pa.Table.from_batches([x for b in halves for x in b.blocks()])
    merged = phrases.bitmap(spark.createDataFrame(table), 10, 10)
    assert phrases.has_bit(merged, __import__("numpy").arange(1024)).tolist() == (whole.counts >= 10).tolist()
