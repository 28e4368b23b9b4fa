import random

import pytest

from tessera.llm import license_texts, licenses

TEXTS = {name: text for name, _, text in license_texts.TEMPLATES}
SCHEMA = "doc_id long, text string"


def statistics(words, sequences):
    """For each word the length of the longest string that ends there and occurs, by search in all strings."""
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in known), 0) for i in range(len(words))]


@pytest.mark.parametrize("seed", range(20))
def test_automaton_gives_matching_statistics_and_places(seed):
    r = random.Random(seed)
    sequences = [[r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(1, 14))] for _ in range(r.randint(1, 4))]
    a = licenses.Automaton(sequences)
    words = [r.choice("abcde") for _ in range(80)]
    want = statistics(words, sequences)
    state = matched = 0
    for i, w in enumerate(words):
        state, matched = a.step(state, matched, w)
        assert matched == want[i]
        string = words[i + 1 - matched : i + 1]
        places = sorted((n, e) for n, s in enumerate(sequences) for e in range(len(s)) if matched and e + 1 >= matched and s[e + 1 - matched : e + 1] == string)
        assert not matched or sorted(a.places[state]) == places


@pytest.mark.parametrize("seed", range(10))
def test_phrases_and_matches_by_search(seed):
    r = random.Random(seed)
    pool = ["mit", "license", "apache", "general", "public", "the", "under", "licensed", "permission", "is", "hereby", "x"]
    words = [r.choice(pool) for _ in range(300)]
    text = "".join(w.upper() + r.choice((" ", "-", "\n", "\x00", ". ")) for w in words).encode()
    s = licenses.Scanner()
    n, phrases, _, _ = s.scan(text)
    want = sorted((i, label) for p, label in license_texts.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert n == 300 and sorted((p["word"], p["label"]) for p in phrases) == want
    lengths = statistics(words, [[w.decode() for w in licenses.words_of(t.encode())] for t in (*(t for t in TEXTS.values() if len(t) < 100), *license_texts.PHRASES)])
    short = licenses.Scanner(tuple(t for t in license_texts.TEMPLATES if len(t[2]) < 100), min_match=2)
    want = [(i, n) for i, n in enumerate(lengths) if n >= 2 and (i + 1 == len(words) or lengths[i + 1] <= n)]
    assert [(i, n) for i, n, _ in short.matches(text, [])] == want


def test_every_template_is_found_alone_and_in_noise():
    s = licenses.Scanner()
    for name, text in TEXTS.items():
        n, _, spans, share = s.scan(f"Foo bar baz: {text.upper()}\nfoo".encode())
        span = next(x for x in spans if x["template"] == name)
        assert (span["first_word"], span["last_word"], span["share"], share) == (3, n - 2, 1.0, 1.0), name
    words = TEXTS["mit"].split()
    broken = " ".join(w if i % 19 != 10 else "// changed" for i, w in enumerate(words))
    (span,) = s.scan(broken.encode())[2]
    assert span["template"] == "mit" and 0.75 <= span["share"] < 0.97
    half = s.scan(" ".join(words[: len(words) // 2]).encode())
    assert half[2] == [] and 0.4 < half[3] < 0.6
    twice = s.scan(f"{TEXTS['mit']} {TEXTS['isc']} {TEXTS['mit']}".encode())[2]
    assert [x["template"] for x in twice] == ["mit", "isc", "mit"]


def test_pieces_cut_no_word():
    text = ("Ünïcode mit-LICENSE\x00x1 " * 50 + "y" * 9000 + " end").encode()
    for size in (1, 5, 64, 1000, 8999):
        assert [w for p in licenses.pieces(text, size) for w in p] == licenses.words_of(text)


def test_rows_and_edges(spark):
    long = "word " * 300_000 + "Licensed under CC BY-NC 4.0."
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, long), (1, "Released under the MIT License."), (None, "Apache  license; GENERAL PUBLIC LICENSE"), (6, "permit license")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], f"{SCHEMA}, labels string, spans string")
    got = sorted((tuple(r) for r in licenses.labels(licenses.scan(docs)).collect()), key=str)
    assert got == sorted(
        [
            (1, 5, 1, 3, 3, "mit", "mit", 1.0), (1, 5, 1, 3, 3, "mit", "mit", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
            (4, 300_007, 0, None, None, "", "cc-by-nc", 1.0), (None, 5, 2, 0, 2, "apache,gpl", "apache,gpl", 1.0), (6, 2, 0, None, None, "", "", 0.0),
        ],
        key=str,
    )
    assert licenses.scan(docs.limit(0)).collect() == []
