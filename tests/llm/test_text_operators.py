import base64
import hashlib
import json
import random
import re
import struct
import time
import wave
import zlib
from io import BytesIO

import pytest

from pyspark.sql import functions as F

from tessera.llm import media, quality, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, 1) for i, t in enumerate(texts)], SCHEMA)


# --- quality ---


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    rng = random.Random(2)
    texts = ["", None, " \n\t", "one", "a\nb\na\r\na\n\n \n", "x " * 500, "é中 | #\x0b\x0cü\x1fz\x85 w", "same " * 8, " not a space"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(7, 60))) * 2 for _ in range(10)]
    got = {r["doc_id"]: r for r in quality.assess(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert tuple(got[i][c] for c in quality.BASE) == want, t
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_quality_thresholds_adapt(spark):
    """Symbols are normal in one source and not in the other."""
    plain = [" ".join(f"word{i * j % 97}" for j in range(40)) for i in range(1, 61)]
    marked = [" ".join(f"word{i * j % 97}###" for j in range(40)) for i in range(1, 61)]
    rows = [(i, t, "en", "plain", 1, 1) for i, t in enumerate(plain)] + [(100 + i, t, "en", None, 1, 1) for i, t in enumerate(marked)] + [(999, marked[0], "en", "plain", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in quality.keep_documents(docs).collect()}
    assert kept == {r[0] for r in rows} - {999}
    assert quality.keep_documents(docs).columns == docs.columns
    none = spark.createDataFrame([], SCHEMA)
    assert quality.assess(none).count() == 0 and quality.keep_documents(none).count() == 0


def test_every_fence_follows_the_data(spark):
    """Two groups with the same shape at other places get other fences, by the quartiles alone; a small group's lie further out."""
    rows = []
    for source, n, shift in (("a", 400, 0), ("b", 400, 100), ("c", 60, 0)):
        for i in range(n):
            k = i * 100 // n
            rows.append((source, 1000, 10, 100, 20 + k // 10 + shift, 50, 4 * (k % 5 == 0) * (1 + k // 50) + (shift // 50) * (k % 5 == 0), 2 * (k % 10 == 0) + shift // 50))
    measured = spark.createDataFrame(rows, "source string, word_chars long, n_symbols long, n_words long, n_marks long, n_different long, n_dup_lines long, n_repeat_words long")
    measured = measured.withColumns({"lang": F.lit("en"), "n_lines": F.lit(100).cast("long"), "base_failed": F.lit(False)})
    found = {r["source"]: r for r in quality.thresholds(quality.sketches(measured)).collect()}
    a, b, c = found["a"], found["b"], found["c"]
    assert a["marks_high"] == 27 + 7 * 5 * (1 + 2 / 20) and b["marks_high"] == 100 + a["marks_high"] and c["marks_high"] > a["marks_high"]
    assert a["variety_low"] == a["word_length_low"] * 0 + 50 and a["marks_low"] == 0 == b["repeats_low"]
    assert all(a[f"{m}_high"] != b[f"{m}_high"] for m in ("marks", "dup_lines", "repeats"))


# --- toxicity ---


@pytest.mark.parametrize("text", ["an Idiot here", "an 1d10t here", "an іdіоt here", "an id​iot, here", "an ＩＤＩＯＴ. here", "an idi0t! here"])
def test_folding(text):
    assert toxicity.fold(text) == toxicity.fold("an idiot here")


def test_exceptions_and_length():
    lexicon = toxicity.Lexicon({" tras": 1.0, " idiot ".replace("l", "i"): 0.5}, [toxicity.fold("trash can")])
    a = lexicon.automaton()
    find = lambda t: toxicity.matches(a, toxicity.fold(t))
    assert len(find("you trash")) == 1 and not find("the trash can is full") and not find("idiotic")
    short, long = (toxicity.density(find(t), toxicity.fold(t)) for t in ("you trash", "you trash " + "word " * 99))
    assert short > long > 0


@pytest.mark.parametrize("seed", range(5))
def test_exceptions_leave_out_what_they_cover(seed):
    """Against a comparison of every match with every exception phrase."""
    rng = random.Random(seed)
    words = ["ab", "abc", "cd", "de", "ef"]
    weights = {f" {w}{rng.choice(['', ' '])}": rng.random() for w in words}
    lexicon = toxicity.Lexicon(weights, [f" {' '.join(rng.choices(words, k=rng.randint(2, 4)))} " for _ in range(6)])
    folded = f" {' '.join(rng.choices(words, k=400))} "
    want = {}
    for term, w in weights.items():
        for m in re.finditer(f"(?={term})", folded):
            want[m.start()] = max(w, want.get(m.start(), 0.0))
    spans = [(m.start(), m.start() + len(p) - 1) for p in lexicon.exceptions for m in re.finditer(f"(?={p})", folded)]
    want = {s: w for s, w in want.items() if not any(a <= s < b for a, b in spans)}
    assert toxicity.matches(lexicon.automaton(), folded) == want


def test_time_of_exceptions_follows_the_text():
    lexicon = toxicity.Lexicon({" bad ": 1.0}, [" bad dog "])
    a = lexicon.automaton()
    folded = " " + "bad dog bad cat " * 8000
    started = time.perf_counter()
    assert len(toxicity.matches(a, folded)) == 8000
    assert time.perf_counter() - started < 2


def test_learned_scores(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgmnr") + rng.choice("aeou") for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorkus", "zorkify", "grix"]))
        rows.append((i, " ".join(words), "en", "s", 1, 1))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None, None, 1, 1), (1001, "", "en", "s", 1, 1), (None, "z0rkus zorkus", "en", "s", 1, 1)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, known)).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i, _ in labels if got[i]["held_out"]] == held
    right = sum(got[i]["predicted"] == t for i, t in labels if i in set(held))
    assert right >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_scores_without_labels(spark):
    docs = docs_of(spark, ["a text", None])
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in toxicity.score(docs, lexicon).collect()] == [0, 0]


# --- media ---


def test_payload_round_trip(spark):
    texts = ["", None, "x" * 192, "x" * 193, "RIFF and BM and GIF89a \x89PNG", "ü" * 500, "same", "same"]
    got = sorted(media.store_documents(docs_of(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for text, r in zip(texts, got, strict=True):
        raw = (text or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["corrected"]
    assert got[6][1:] == got[7][1:]


def test_sniffing_and_carving(spark):
    samples = bytes(range(192)) * 2
    stored = [media.to_wav(samples), media.to_bmp(samples), media.to_png(samples)]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xda\x00\x02xx\xff\x00y\xff\xd9"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    blob = b"BM RIFF GIF8 \x89PNG " + b"--".join([*stored, jpeg, gif]) + b" tail"
    rows = media.carve(spark.createDataFrame([(1, bytearray(blob), "image/png"), (2, None, None), (3, bytearray(b"RIFF only"), "audio/wav")], "id long, blob binary, declared string")).orderBy("ordinal").collect()
    assert [r["mime"] for r in rows] == ["audio/wav", "image/bmp", "image/png", "image/jpeg", "image/gif"]
    assert [bytes(r["media"]) for r in rows] == [*stored, jpeg, gif]
    assert [r["corrected"] for r in rows] == [True, True, False, True, True]
    with wave.open(BytesIO(stored[0])) as w:
        assert w.readframes(w.getnframes()) == samples
    assert all(media.read_samples(r["mime"], bytes(r["media"])) == samples for r in rows[:3])


@pytest.mark.parametrize("writer", [media.to_wav, media.to_bmp, media.to_png])
def test_damaged_media_are_rejected(writer):
    whole = writer(b"a" * 384)
    assert len(media.sniff(whole)) == 1
    assert not media.sniff(whole[:-1])
    damaged = bytearray(whole)
    damaged[4 if writer is media.to_wav else 2 if writer is media.to_bmp else 20] ^= 0x40
    assert not media.sniff(bytes(damaged))


# --- secrets ---


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, b"".join(der(0x02, bytes([1]) + bytes(range(60))) for _ in range(9)))
SSH = b"".join(struct.pack(">I", len(x)) + x for x in (b"ssh-ed25519", bytes(range(32))))


def token(header, body):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part(header)}.{part(body)}.c2lnbmF0dXJl"


def test_base_spans():
    text = 'é Password: "hunter22", ſecret=abcdefg API-key=zzzzzz api_key = short1 token=abc AKIA' + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2
    spans = secrets.base_spans(text)
    assert [text[a:b] for a, b, k in spans if k == "assign"] == ['Password: "hunter22', "api_key = short1"]
    assert [b - a for a, b, k in spans if k == "access"] == [20]
    assert [b - a for a, b, k in spans if k == "hex"] == [32]


def test_structure_confirms():
    good = base64.b64encode(KEY).decode()
    wrapped = "-----BEGIN-----\n" + "\n".join(good[i : i + 64] for i in range(0, len(good), 64)) + "\n-----END-----"
    ssh = base64.b64encode(SSH).decode()
    jwt = token({"alg": "HS256"}, {"sub": 1})
    for text, kind in ((good, "key"), (wrapped, "key"), (KEY.hex(), "key"), (ssh, "ssh"), (f"x {jwt} y", "jwt")):
        assert [k for _, _, k in secrets.confirmed_spans(text)] == [kind], text
    broken = bytearray(KEY)
    broken[3] ^= 1
    for text in (base64.b64encode(bytes(broken)).decode(), base64.b64encode(KEY[:-1]).decode(), base64.b64encode(SSH + b"x").decode(), token({"typ": "x"}, {}), "MI" + "A" * 200):
        assert not secrets.confirmed_spans(text), text


def test_scan_and_redact(spark):
    texts = ["password=hunter22 and " + token({"alg": "none"}, {}), "", None, "clean", "secret: " + KEY.hex()]
    docs = docs_of(spark, texts)
    got = sorted(secrets.scan(docs).collect(), key=lambda r: r["doc_id"])
    assert got[0]["spans"].startswith("assign:0:17,jwt:22:") and got[0]["n_assign"] == 1 and got[0]["n_confirmed"] == 1
    assert got[0]["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest()
    assert got[1]["spans"] == got[2]["spans"] == got[3]["spans"] == ""
    assert got[4]["n_assign"] == got[4]["n_hex"] == 1
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean == {0: "[assign] and [jwt]", 1: "", 2: None, 3: "clean", 4: "[assign+hex+key]"}
    assert secrets.redact(docs).columns == docs.columns
    none = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(none).count() == 0 and media.store_documents(none).count() == 0
