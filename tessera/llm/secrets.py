"""Secret scan with structural confirmation.

Candidates by pattern: assignments of a secret's name, access key ids, long hex runs. On top
of these, runs of base64, base64url or hex are decoded and parsed, and reported only where
the structure holds: DER whose nested lengths fill the value exactly (private and public
keys, certificates), SSH wire format whose length-prefixed fields fill the value (public keys,
OpenSSH private keys), and signed tokens whose header is a JSON object that names an algorithm. A base64 value ends where its own DER
or SSH lengths say, whatever the text goes on with on the next line.

Kinds of spans: assign, access, hex, then key (DER), ssh, jwt. Spans are code points, end
exclusive. Null and empty texts have no spans. Equal rows give equal rows; columns other
than doc_id and text are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A text without any of these, in lower case, has no assignment.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
#: Starts of base64 or base64url that may be DER (any SEQUENCE), an SSH public key or an OpenSSH private key. A run starts
#: after anything that is not of its alphabet, or after a line break that is written as an escape.
DER_RUN = re.compile(r"M(?:(?<![A-Za-z0-9+/]M)|(?<=\\[nrt]M))[A-P][A-Za-z0-9+/_-]{20,}")
SSH_RUN = re.compile(r"AAAA(?:(?<![A-Za-z0-9+/]AAAA)|(?<=\\[nrt]AAAA))[A-Z][A-Za-z0-9+/_-]{20,}")
OPENSSH_RUN = re.compile(r"b3BlbnNzaC1rZXktdjEA(?:(?<![A-Za-z0-9+/]b3BlbnNzaC1rZXktdjEA)|(?<=\\[nrt]b3BlbnNzaC1rZXktdjEA))")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
LINE_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:8[12])?[0-9A-Fa-f]{40,}(?![0-9A-Fa-f])")
#: Tags of the DER values that keys and certificates are made of.
PRIMITIVE = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0A, 0x0C, 0x13, 0x14, 0x16, 0x17, 0x18, 0x1E}
#: Fields of the public keys of each type.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
SSH_TYPES = tuple(SSH_FIELDS)
OPENSSH = b"openssh-key-v1\0"


def der_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at `at`, if its length is minimal and within data."""
    if at + 2 > len(data):
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or start + width > len(data) or data[start] == 0:
            return None
        n, start = int.from_bytes(data[start : start + width], "big"), start + width
        if n < 0x80:
            return None
    return (tag, start, start + n) if start + n <= len(data) else None


def der_fills(data: bytes, start: int, end: int) -> int:
    """Number of values that fill data[start:end] exactly, nested ones included at any depth; 0 if they don't."""
    count, open_values = 0, [(start, end)]
    while open_values:
        start, end = open_values.pop()
        while start < end:
            head = der_header(data, start)
            if head is None or head[2] > end:
                return 0
            tag, a, b = head
            if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
                open_values.append((a, b))
            elif tag not in PRIMITIVE and tag & 0xE0 != 0x80:
                return 0
            count, start = count + 1, b
    return count


def is_key(data: bytes) -> bool:
    """One SEQUENCE that is all of data, with an INTEGER or OBJECT IDENTIFIER early in it."""
    head = der_header(data, 0)
    if head is None or head[0] != 0x30 or head[2] != len(data) or not der_fills(data, 0, len(data)) > 3:
        return False
    inner = data[head[1]]
    return inner == 0x02 or inner == 0x30


def is_ssh(data: bytes) -> bool:
    """Length-prefixed fields that fill data, the first a key type; or an OpenSSH private key."""
    fields, at = [], 0
    if data.startswith(OPENSSH):
        return openssh_size(data, len(data)) == len(data)
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0] in SSH_TYPES


def _fields_end(data: bytes, at: int, n: int, most: int) -> int | None:
    """Where n length-prefixed fields end; -1 if past `most`, None if data ends before that is known."""
    for _ in range(n):
        if at > most:
            return -1
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def openssh_size(data: bytes, most: int) -> int | None:
    """Bytes that an OpenSSH private key says it has: cipher, derivation and its options, public keys, the private part."""
    at = _fields_end(data, len(OPENSSH), 3, most)
    if at is None or at == -1 or at + 4 > len(data):
        return -1 if at == -1 else None
    n = int.from_bytes(data[at : at + 4], "big")
    return _fields_end(data, at + 4, n + 1, most)


def ssh_size(data: bytes, most: int) -> int | None:
    """Bytes that an SSH key says it has; -1 if it can't be one of `most` bytes, None if data ends before that is known."""
    if data.startswith(OPENSSH):
        return openssh_size(data, most)
    n = int.from_bytes(data[:4], "big")
    if n > 64:
        return -1
    if 4 + n > len(data):
        return None
    count = SSH_FIELDS.get(data[4 : 4 + n])
    return -1 if count is None else _fields_end(data, 0, count, most)


def der_size(data: bytes, most: int) -> int | None:
    """Bytes that a DER SEQUENCE says it has, its header included; -1 if it can't be a key of `most` bytes."""
    n, start = data[1], 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4:
            return -1
        n, start = int.from_bytes(data[2 : 2 + width], "big"), 2 + width
    return start + n if data[0] == 0x30 and data[start] in (0x02, 0x30) and start + n <= most else -1


def value_at(text: str, at: int, size) -> tuple[int, bytes] | None:
    """(end, bytes) of the base64 value that starts here and is as long as it declares.

    Mostly the first line says how long that is, and lines are taken until it is reached; if it
    doesn't, all lines that follow are decoded once. The value's own length is the only bound. It ends there,
    padding included, and must be at the end of a run of its alphabet: base64url where it has one of its signs.
    """
    most = (len(text) - at) * 3 // 4
    run = RUN.match(text, at)
    n = size(_base64(run[0][: len(run[0]) & -4]), most)
    lines, ends, have = [], [], 0
    while run and n != -1 and (n is None or have * 3 < n * 4):
        lines.append(run[0])
        have += len(run[0])
        ends.append(run.end())
        broken = LINE_BREAK.match(text, run.end())
        run = broken and RUN.match(text, broken.end())
    whole = "".join(lines)
    if n is None:
        n = size(_base64(whole[: have & -4]), most)
    if n is None or n < 16 or have < (need := -(-n * 4 // 3)):
        return None
    # the line that holds the last character of the value
    for line, stop in zip(reversed(lines), reversed(ends), strict=True):
        have -= len(line)
        if have < need:
            end = stop - len(line) + need - have
            break
    after = text[end : end + 1]
    if (after.isascii() and after.isalnum()) or after in ("+", "/"):
        return None
    padding = re.compile(f"={{0,{-need % 4}}}").match(text, end)
    data = _base64(whole[:need])
    return (padding.end(), data) if data is not None else None


def _base64(text: str) -> bytes | None:
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(header: str, body: str) -> bool:
    """The header is a JSON object with a string alg, and the body is JSON too."""
    try:
        head, claims = json.loads(_base64(header) or b""), json.loads(_base64(body) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


RUNS = ((DER_RUN, der_size, is_key, "key"), (SSH_RUN, ssh_size, is_ssh, "ssh"), (OPENSSH_RUN, ssh_size, is_ssh, "ssh"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """What decodes to a key or a signed token."""
    spans = []
    if "eyJ" in text:
        spans += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    for pattern, size, holds, kind in RUNS:
        at = 0
        while m := pattern.search(text, at):
            found = value_at(text, m.start(), size)
            at = m.end()
            if found and holds(found[1]):
                spans.append((m.start(), found[0], kind))
                at = found[0]
    for m in HEX_DER.finditer(text):
        if not len(m[0]) % 2 and is_key(bytes.fromhex(m[0])):
            spans.append((m.start(), m.end(), "key"))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_confirmed of every document."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = ([], [], [], []), [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = confirmed_spans(text or "")
            for column, kind in zip(counts, BASE, strict=False):
                column.append(sum(s[2] == kind for s in base))
            counts[3].append(len(more))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + more))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)


def redacted(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by its kinds."""
    spans = sorted(base_spans(text) + confirmed_spans(text))
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kinds = spans[i][0], spans[i][1], {spans[i][2]}
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b, kinds = max(b, spans[i][1]), kinds | {spans[i][2]}
            i += 1
        out += [text[at:a], f"[{'+'.join(k for k in KINDS if k in kinds)}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; n_chars, where there is one, follows. Null texts stay null."""
    columns = docs.columns

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index("text")
        texts = [t if t is None else redacted(t) for t in batch.column(i).to_pylist()]
        return batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = map_arrow(docs, kernel, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
