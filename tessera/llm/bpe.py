"""Byte-level BPE: overlapping chunk encoding and byte-exact decoding.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in
parallel. A chunk that starts inside a pre-token is out of step at first; where a
boundary of its own lies on a boundary of the chunk before, both are in step again, and
the text is cut there. Each piece between two cuts is then encoded by itself, and the
ids are put together in order. Decoding concatenates the raw bytes of the ids.

How far a chunk reaches into the next is settled where the text is cut up: far enough that the
next chunk has some boundaries of its own there. A match that covers the usual overlap (a run
of letters, say) widens the overlap of its chunk alone, and where a whole chunk has no
boundaries it is no chunk of its own. So one long match costs no cut but those within it.

Null and empty texts have no ids. Rows are told apart by an internal row id, so repeated
rows and null doc_ids each keep their own result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
#: Boundaries that an overlap holds at least.
MIN_EDGES = 4
#: A match that ends so near to the end of a chunk may look different in the whole text.
MARGIN = 4

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of byte strings, with the split pattern that belongs to them."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: token for token, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.raw}

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens of a text."""
        return [m.end() for m in self.pattern.finditer(text)]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode_added(self, text: str, added: dict[str, int]) -> list[int]:
        """Like encode(), but the added tokens count as such: the texts between them are encoded by themselves."""
        if not any(token in text for token in added):
            return self.encode(text)
        splits = regex.split("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return [i for part in splits for i in ([added[part]] if part in added else self.encode(part))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def digest(self, ids) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and path."""
    return Vocabulary(path)


def edges_of(vocab: Vocabulary, text: str, last: bool) -> list[int]:
    """Boundaries of a stretch of text that a cut may lie on.

    Only those after a character that is no white space count: a piece cut there splits into
    the same pre-tokens as it does within the text. What the end of the stretch may have
    changed does not count, unless the text ends there.
    """
    trusted = len(text) if last else len(text) - MARGIN
    return [e for e in vocab.boundaries(text) if e <= trusted and not text[e - 1].isspace()]


def chunk_spans(vocab: Vocabulary, text: str, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, head, tail) of the chunks of a text: up to head the chunk before reaches into it, from tail on it reaches into the next."""
    out = []
    n, start, head = len(text), 0, 0
    while True:
        tail, width = start + chunk, overlap
        while tail < n:
            end = min(n, tail + width)
            if len(edges_of(vocab, text[tail:end], end == n)) >= MIN_EDGES:
                break
            if end == n or width >= chunk:  # nothing to come into step by: the chunk goes on
                tail, width = tail + width, overlap
            else:
                width *= 2
        if tail >= n:
            out.append((start, n, head, n))
            return out
        end = min(n, tail + width)
        out.append((start, end, head, tail))
        start, head = tail, end


def chunk_edges(vocab: Vocabulary, text: str, start: int, head: int, tail: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk, in the whole text's positions: those up to head, and those from tail on."""
    ends = [start + e for e in edges_of(vocab, text, last)]
    return [e for e in ends if e <= head], [e for e in ends if e >= tail]


def stitch(edges: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """(host, cut) of each chunk: where its piece begins, or the host chunk whose piece it continues.

    The boundaries behind a chunk's own end are right if the chunk came into step before; it did at
    its cut, or it goes on from its host. Two chunks whose boundaries never agree within their
    overlap make one piece with all that follows: which boundaries are right is then not known.
    """
    out = [(0, 0)]
    tail = edges[0][1]
    for i, (head, own_tail) in enumerate(edges[1:], 1):
        common = sorted(set(tail) & set(head))
        if common:
            out.append((i, common[0]))
            tail = own_tail
        else:
            out.append((out[-1][0], -1))
            tail = []  # not in step: nothing of this chunk's own split is known to be right
    return out


def encode_chunked(vocab: Vocabulary, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The method on one text, in one place."""
    edges = [chunk_edges(vocab, text[a:b], a, head, tail, b == len(text)) for a, b, head, tail in chunk_spans(vocab, text, chunk, overlap)]
    cuts = [c for _, c in stitch(edges) if c >= 0] + [len(text)]
    return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in vocab.encode(text[a:b])]


def _finished(path: str):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        n, ids_hash, text_hash = [], [], []
        for text in batch.column(1).to_pylist():
            ids = vocab.encode(text or "")
            n.append(len(ids))
            ids_hash.append(vocab.digest(ids))
            text_hash.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return kernel


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Texts of one chunk are finished where they are read. The chunks of longer texts are dealt
    out, so that one very long text does not hold a task; only their boundaries are gathered
    by text for the cuts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = map_arrow(docs.where(~long), _finished(path), RESULT)
    return short.unionByName(_encode_long(docs.where(long), path, chunk, overlap))


def _encode_long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    def cut_up(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for rid, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, (a, b, head, tail) in enumerate(chunk_spans(vocab, text, chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([{"rid": rid, "doc_id": doc_id, "idx": i, "last": b == len(text), "start": a, "head_end": head, "tail_start": tail, "text": text[a:b]}], schema)

    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("idx", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()), ("head_end", pa.int64()), ("tail_start", pa.int64()), ("text", pa.string())])
    chunks = (
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
        .mapInArrow(cut_up, "rid long, doc_id long, idx int, last boolean, start long, head_end long, tail_start long, text string")
        .repartition("rid", "idx")
    )

    def edges(batches):
        vocab = vocabulary(path)
        for batch in batches:
            x = batch.to_pydict()
            found = [chunk_edges(vocab, *row) for row in zip(x["text"], x["start"], x["head_end"], x["tail_start"], x["last"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("idx"), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([t for _, t in found], pa.list_(pa.int64()))], ["rid", "idx", "head", "tail"])

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        made = stitch([(list(h), list(t)) for h, t in zip(pdf["head"], pdf["tail"], strict=True)])
        nxt = [next((c for _, c in made[i + 1 :] if c >= 0), -1) for i in range(len(made))]
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "idx": pdf["idx"].to_numpy(), "host": [h for h, _ in made], "cut": [c for _, c in made], "until": nxt})

    at = chunks.mapInArrow(edges, "rid long, idx int, head array<long>, tail array<long>").groupBy("rid").applyInPandas(cuts, "rid long, idx int, host int, cut long, until long")

    def pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = vocabulary(path)
        pdf = pdf.sort_values("idx")
        first = pdf.iloc[0]
        whole = "".join(t[: end - at] for t, at, end in zip(pdf["text"].iloc[:-1], pdf["start"], pdf["tail_start"], strict=False)) + pdf["text"].iloc[-1]
        a = int(first["cut"]) - int(first["start"])
        b = int(first["until"]) - int(first["start"]) if first["until"] >= 0 else len(whole)
        ids = vocab.encode(whole[a:b])
        return pd.DataFrame({"rid": [first["rid"]], "doc_id": [first["doc_id"]], "host": [first["host"]], "ids": [ids]})

    encoded = chunks.join(at, ["rid", "idx"]).groupBy("rid", "host").applyInPandas(pieces, "rid long, doc_id long, host int, ids array<int>")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab = vocabulary(path)
        ids = [int(i) for part in pdf.sort_values("host")["ids"] for i in part]
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "n_tokens": [len(ids)], "ids_sha256": [vocab.digest(ids)], "decoded_sha256": [hashlib.sha256(vocab.decode(ids)).hexdigest()]})

    return encoded.groupBy("rid").applyInPandas(gather, RESULT)
