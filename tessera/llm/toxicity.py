"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and accents-free look-alikes to Latin letters, undoes
digit and symbol substitutions within words, and turns all else between words into single
spaces, so that a lexicon entry is the text " stem" (any word that begins so) or " word ".
The automaton holds all entries and all exception phrases; a match inside an exception
phrase does not count. The score is the matched weight by length, carried to 0..1 so that
0.3 is the boundary learned from the labels.

The lexicon is learned: document counts of words and stems among labelled rows give weights
(log odds), a likelihood-ratio test decides which are kept, and contexts in which an entry
occurs only in clean rows become exception phrases. At most `MAX_TRAIN` labelled rows are
used, by the order of a hash of their doc_id; all entries and phrases that they bear out are kept.

Null and empty texts score 0. A null doc_id is not held out and has no label; repeated rows
score alike; columns other than doc_id and text are ignored. With no labels every score is 0.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

MAX_TRAIN = 20_000
STEMS = (4, 5, 6, 7, 8, 9)
#: Least likelihood ratio (chi-squared, one degree of freedom) and least share of toxic rows of an entry.
MIN_G2 = 22.0
MIN_PRECISION = 0.6
#: Words that every text is taken to have besides its own, so that one word alone is no certainty.
EXTRA_WORDS = 10
BOUNDARY = 0.3
#: Times an entry must occur in one context in clean rows, and never in toxic ones, to make an exception phrase.
MIN_EXCEPTION = 3

#: Look-alikes of Latin letters, by letter.
HOMOGLYPHS = {
    "a": "аαａ@", "b": "Ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "g": "ɡｇ", "h": "һｈ", "i": "іιｉ", "j": "јｊ", "k": "кκｋ", "m": "мｍ",
    "n": "ոｎ", "o": "оοｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ$", "t": "тτｔ", "u": "υｕ", "v": "ѵνｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уｙ", "z": "ｚ", "l": "ӏｌ", "f": "ｆ",
}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
#: l, i and 1 look alike, so all are read as i.
SAME = {"l": "i", "ӏ": "i", "|": "i", "!": "i", "ｌ": "i"}
SYMBOLS = re.compile(r"(?<=\w)[@$!|](?=\w)")
INVISIBLE = "­​‌‍⁠﻿"


class _Table(dict):
    """A translation for str.translate that decides on unseen characters once."""

    def __missing__(self, code: int):
        c = chr(code)
        out = None if c in INVISIBLE else c if c.isalpha() else " "
        self[code] = out
        return out


@functools.cache
def _table() -> _Table:
    table = _Table()
    for letter, likes in HOMOGLYPHS.items():
        for c in likes:
            table[ord(c)] = letter
    for digit, letter in DIGITS.items():
        table[ord(digit)] = letter
    for c, letter in SAME.items():
        table[ord(c)] = letter
    for c in "@$!|":
        table[ord(c)] = " "
    return table


_WITHIN = {"@": "a", "$": "s", "!": "i", "|": "i"}


def fold(text: str) -> str:
    """The folded words of a text, each with a space before it, and one at the end."""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SYMBOLS.sub(lambda m: _WITHIN[m[0]], text)
    return f" {' '.join(text.translate(_table()).split())} "


@dataclass
class Lexicon:
    """weights: by entry, 0 to 1. half: the weight by length at which the score is BOUNDARY."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    half: float = 0.01

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if not len(a):
            return None
        a.make_automaton()
        return a


def matches(automaton: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Weight by the start of each matched word; what an exception phrase covers is left out."""
    if automaton is None:
        return {}
    found: dict[int, float] = {}
    excepted = []
    for last, (n, w) in automaton.iter(folded):
        start = last + 1 - n
        if w is None:
            excepted.append((start, last))
        elif w > found.get(start, 0.0):
            found[start] = w
    # one sweep: of the phrases that begin by a match, the one that reaches furthest decides
    excepted.sort()
    i, reach = 0, -1
    for start in sorted(found) if excepted else ():
        while i < len(excepted) and excepted[i][0] <= start:
            reach = max(reach, excepted[i][1])
            i += 1
        if start < reach:
            del found[start]
    return found


def density(found: dict[int, float], folded: str) -> float:
    return sum(found.values()) / (folded.count(" ") - 1 + EXTRA_WORDS)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """text, toxic of at most `limit` labelled rows that are not held out. The bounded side is broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id").select("text", "toxic")


def _features(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        for n in STEMS:
            if len(w) >= n:
                out.add(f" {w[:n]}")
    return out


def _g2(toxic: int, clean: int) -> Column:
    """Likelihood ratio of a feature in t of `toxic` and c of `clean` rows."""
    share = (F.col("t") + F.col("c")) / (toxic + clean)
    total = F.lit(0.0)
    for seen, size in ((F.col("t"), toxic), (F.col("c"), clean)):
        for x, expected in ((seen, size * share), (size - seen, size * (1 - share))):
            total = total + F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    return 2 * total


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Lexicon:
    """A lexicon from the labels. What reaches the driver is the lexicon and `limit` densities, which the training rows bound."""
    train = materialise(training_rows(docs, labels, limit), "training_rows")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[int(toxic > 0)].update(_features(fold(text or "")))
            seen[int(toxic > 0)][""] += 1
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][x] for x in terms], pa.int64()), pa.array([seen[0][x] for x in terms], pa.int64())], ["term", "t", "c"])

    counts = materialise(map_arrow(train, count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "term_counts")
    rows = counts.where("term = ''").collect()
    if not rows or not rows[0]["t"] or not rows[0]["c"]:
        return Lexicon({})
    toxic, clean = rows[0]["t"], rows[0]["c"]
    telling = (F.col("term") != "") & (F.col("t") >= 4) & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("c"))) & (_g2(toxic, clean) >= MIN_G2)
    odds = {x["term"]: (math.log((x["t"] + 0.5) / (toxic + 1)) - math.log((x["c"] + 0.5) / (clean + 1)), x["t"]) for x in counts.where(telling).collect()}
    # a stem stands for all its words; of nested stems the shortest is enough
    stems = {s for s in odds if not s.endswith(" ")}
    kept = {}
    for term, (w, t) in sorted(odds.items(), key=lambda x: (-x[1][1], x[0])):
        word = term.strip()
        if not any(f" {word[:n]}" in stems and f" {word[:n]}" != term and odds[f" {word[:n]}"][0] >= w - 1.5 for n in STEMS if n < len(word) + term.endswith(" ")):
            kept[term] = w
    most = max(kept.values(), default=1.0)
    lexicon = Lexicon({k: w / most for k, w in kept.items()})

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        automaton, seen = lexicon.automaton(), (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folded = fold(text or "")
            for start in matches(automaton, folded):
                end = folded.index(" ", start + 1)
                if start:
                    seen[int(label > 0)][folded[folded.rindex(" ", 0, start) : end + 1]] += 1
                if end + 1 < len(folded):
                    seen[int(label > 0)][folded[start : folded.index(" ", end + 1) + 1]] += 1
        terms = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][x] for x in terms], pa.int64()), pa.array([seen[0][x] for x in terms], pa.int64())], ["term", "t", "c"])

    phrases = map_arrow(train, contexts, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t = 0 AND c >= {MIN_EXCEPTION}")
    lexicon.exceptions = [x["term"] for x in phrases.orderBy(F.desc("c"), "term").collect()]

    def densities(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = lexicon.automaton()
        found = [density(matches(automaton, f), f) for f in (fold(t or "") for t in batch.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["density", "toxic"])

    rows = [(x["density"], x["toxic"] > 0) for x in map_arrow(train, densities, "density double, toxic int").where("density > 0").limit(limit).collect()]
    lexicon.half = boundary(rows)
    return lexicon


def boundary(rows: list[tuple[float, bool]]) -> float:
    """The density between toxic and clean rows that errs least, halfway (by ratio) between its neighbours."""
    rows = sorted(rows)
    if not rows:
        return 0.01
    right = sum(label for _, label in rows)  # rows at or above the cut are called toxic
    clean_below = 0
    best, at = right - sum(not label for _, label in rows), 0
    gain = best
    for i, (d, label) in enumerate(rows, 1):
        gain += -1 if label else 1
        clean_below += not label
        if gain > best and (i == len(rows) or rows[i][0] > d):
            best, at = gain, i
    low = rows[at - 1][0] if at else rows[0][0] / 4
    high = rows[at][0] if at < len(rows) else 2 * rows[-1][0]
    return math.sqrt(low * high)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    steep = lexicon.half * (1 - BOUNDARY) / BOUNDARY

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = lexicon.automaton()
        out = []
        for text in batch.column(2).to_pylist():
            folded = fold(text or "")
            d = density(matches(automaton, folded), folded)
            out.append(d / (d + steep))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(x >= BOUNDARY) for x in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), kernel, "doc_id long, held_out boolean, score double, predicted int")
