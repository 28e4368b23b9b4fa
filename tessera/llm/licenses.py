"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds all strings of words that occur in any template. A text runs through it once;
after each word the state says which is the longest string that ends there and occurs in a template
(the matching statistics). Where that string cannot grow, it is a maximal match: one of MIN_MATCH
words or more becomes an anchor at each of its places in templates. Anchors of one template that
follow each other in the text and in the template, with gaps of MAX_GAP words at most in either,
are chained; a chain that covers COVER of the template's words is a span. Of spans of one template
that overlap the one that covers most counts, and of equal ones the first.

Phrases that name a licence are strings of the automaton too: a phrase ends wherever the current
string has it as a suffix, which the suffix links tell.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z as a-z. Null and
empty texts have no words, no spans and score 0. Long texts run through in pieces, with the state
carried over. Each row is scanned by itself, repeated rows alike; an empty table gives an empty
result; other columns than doc_id and text are ignored. Templates are a parameter, and the automaton
is bounded by their words, not by the texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, null_safe_bytes
from .license_texts import PHRASES, TEMPLATES

#: Words of the shortest anchor, words between anchors of a chain, and the least share of a template that a span covers.
MIN_MATCH, MAX_GAP, COVER = 4, 16, 0.75
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20
#: ASCII bytes: letters in lower case, digits as they are, blanks for the others. Bytes beyond ASCII stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

Templates = tuple[tuple[str, str, str], ...]
SPAN = "struct<template: string, label: string, first_word: long, last_word: long, covered: long, share: double>"
SCHEMA = f"doc_id long, n_words long, phrases array<struct<label: string, word: long>>, spans array<{SPAN}>, share double"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists; a word is never cut."""
    at = 0
    while at < len(text):
        piece = text[at : at + size].translate(WORD_BYTES)
        # a piece ends where a word does
        more = at + len(piece)
        while more < len(text) and not piece.endswith(b" "):
            piece += (step := text[more : more + 4096].translate(WORD_BYTES)).partition(b" ")[0]
            more += min(len(step), len(step.partition(b" ")[0]) + (b" " in step))
            if b" " in step:
                break
        yield piece.split()
        at = more


class Automaton:
    """Suffix automaton of several sequences. State 0 is the empty string."""

    def __init__(self, sequences: Iterable[Sequence]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.places[last].append((number, at))
        # what ends in a state ends in all its suffixes
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.link) - 1

    def _extend(self, last: int, symbol) -> int:
        """The state of the string of `last` and the symbol."""
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, symbol)
        return new

    def _split(self, at: int, symbol) -> int:
        """The target of a move, parted from the longer strings in its state."""
        target = self.next[at][symbol]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def walk(self, sequence: Sequence) -> int:
        """The state of a string that occurs."""
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state

    def step(self, state: int, matched: int, symbol) -> tuple[int, int]:
        """State and length of the longest suffix that occurs, after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(symbol)
        return (0, 0) if to is None else (to, matched + 1)


@dataclass
class Chain:
    covered: int
    first: int
    last: int
    at: int  # last word of the template


class Scanner:
    def __init__(self, templates: Templates = TEMPLATES, phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, cover: float = COVER):
        self.templates, self.min_match, self.max_gap, self.cover = templates, min_match, max_gap, cover
        named = [(words_of(p.encode()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        texts = [words_of(text.encode()) for _, _, text in templates]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(chain(*texts, *(p for p, _ in named))))}
        self.lengths = [len(t) for t in texts]
        self.automaton = Automaton([[self.ids[w] for w in t] for t in (*texts, *(p for p, _ in named))])
        self.endings = self._endings(named)

    def _endings(self, named: list[tuple[list[bytes], str]]) -> list[tuple[tuple[int, str], ...]]:
        """For each state, (words, label) of the phrases that its longest string ends with."""
        a = self.automaton
        out: list[tuple[tuple[int, str], ...]] = [()] * len(a.link)
        for phrase, label in named:
            out[s] = (*out[s := a.walk([self.ids[w] for w in phrase])], (len(phrase), label))
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            out[state] = (*out[state], *out[a.link[state]])
        return out

    def matches(self, text: bytes, phrases: list[dict]) -> Iterator[tuple[int, int, int]]:
        """(last word, words, state) of each maximal match of min_match words, in order; phrases gets the phrases found. Returns the number of words."""
        step, endings, known, least = self.automaton.step, self.endings, self.ids.get, self.min_match
        at, state, matched = 0, 0, 0
        for words in pieces(text):
            for at, symbol in enumerate(map(known, words), at):
                if symbol is None:
                    if state:
                        if matched >= least:
                            yield at - 1, matched, state
                        state = matched = 0
                    continue
                to, now = step(state, matched, symbol)
                if now <= matched and matched >= least:
                    yield at - 1, matched, state
                state, matched = to, now
                for size, label in endings[state]:
                    if matched >= size:
                        phrases.append({"label": label, "word": at - size + 1})
            at += bool(words)
        if matched >= least:
            yield at - 1, matched, state
        return at

    def scan(self, text: bytes) -> tuple[int, list[dict], list[dict], float]:
        """Number of words, phrases and spans of a text, and the greatest share of a template that any chain covers."""
        phrases: list[dict] = []
        best = 0.0
        chains: dict[int, list[Chain]] = {}
        open_: dict[int, list[Chain]] = {}
        found = self.matches(text, phrases)
        while True:
            try:
                end, size, state = next(found)
            except StopIteration as e:
                n_words = e.value
                break
            for number, at in self.automaton.places[state]:
                if number < len(self.templates):
                    live = open_.setdefault(number, [])
                    live[:] = [c for c in live if c.last + self.max_gap >= end - size]
                    new = self._joined(live, end, size, at)
                    live.append(new)
                    best = max(best, new.covered / self.lengths[number])
                    if new.covered >= self.cover * self.lengths[number]:
                        chains.setdefault(number, []).append(new)
        spans = [self._span(number, c) for number, of in chains.items() for c in _apart(of)]
        return n_words, phrases, sorted(spans, key=lambda s: (s["first_word"], s["last_word"], s["template"])), best

    def _joined(self, live: list[Chain], end: int, size: int, at: int) -> Chain:
        """The chain that covers most of those that the anchor makes on its own or after one of the live ones."""
        best = Chain(size, end - size + 1, end, at)
        for c in live:
            # where anchors overlap, in the text or in the template, the words count once
            new = min(size, end - c.last, at - c.at)
            gaps = max(end - size - c.last, at - size - c.at)
            if new > 0 and gaps <= self.max_gap and c.covered + new > best.covered:
                best = Chain(c.covered + new, c.first, end, at)
        return best

    def _span(self, number: int, c: Chain) -> dict:
        name, label, _ = self.templates[number]
        return {"template": name, "label": label, "first_word": c.first, "last_word": c.last, "covered": c.covered, "share": c.covered / self.lengths[number]}


def _apart(chains: list[Chain]) -> list[Chain]:
    """Chains that do not overlap, those that cover most first."""
    taken: list[tuple[int, int]] = []
    out = []
    for c in sorted(chains, key=lambda c: (-c.covered, c.first, c.last)):
        i = bisect_left(taken, (c.first, c.first))
        if (i == 0 or taken[i - 1][1] < c.first) and (i == len(taken) or taken[i][0] > c.last):
            insort(taken, (c.first, c.last))
            out.append(c)
    return out


@lru_cache(maxsize=4)
def _scanner(templates: Templates) -> Scanner:
    """One for a worker."""
    return Scanner(templates)


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """doc_id, n_words, phrases (label and first word), spans (template, label, first and last word, covered words, share) and share of every text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_scanner(templates).scan(text) for text in null_safe_bytes(batch.column(1))]
        found = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), KINDS.values(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *found], ["doc_id", *KINDS])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), kernel, SCHEMA)


PHRASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), *zip(("first_word", "last_word", "covered"), repeat(pa.int64())), ("share", pa.float64())]))
KINDS = {"n_words": pa.int64(), "phrases": PHRASE_TYPE, "spans": SPAN_TYPE, "share": pa.float64()}


def labels(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score: the greatest share of a template or phrase that the text covers."""
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.col("share"))
    return scanned.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.word").alias("first_word"), F.array_max("phrases.word").alias("last_word"),
        joined("phrases.label").alias("base_labels"), joined(F.concat("phrases.label", "spans.label")).alias("labels"), score.alias("score"),
    )
