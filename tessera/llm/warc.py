"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response record is parsed (WARC headers, HTTP headers, body), its digests are checked, and
two records are derived from it: metadata (what the HTTP headers and the page declare, and its
links) and a conversion (the page's plain text). Both name the response in WARC-Refers-To and
carry its target URI and date on; the metadata record keeps the source's HTTP headers, and both
keep its payload digest, so a derivative can be traced to its source and checked against it.

Record ids are UUIDs of the source's id and the kind, so a task that runs again makes the same
records. A null URL becomes an empty target and a null body an empty payload; pages are told
apart by page_id, url and payload; repeated rows give repeated records. Columns other than
page_id, url, html are ignored. A record that cannot be parsed or decoded or fails its digest
gives one row of kind "error" and no derivatives.

The payload is decoded before it is read: chunked transfer, gzip (all members) or deflate, then the
character set that the HTTP header, a byte order mark or the page names, if pages may have it, UTF-8
otherwise. A payload that is cut short, or grows past MOST_INFLATED, is an error. Markup is walked
once, from tag to tag; a tag ends at the first `>` that is in no quoted value, and a comment, script
or style that is never closed takes the rest of the page.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, null_safe_bytes

VERSION = b"WARC/1.1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tessera:warc")
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol tr table br article section nav footer header title head body".split())
#: Elements whose content is not shown, by what closes them.
HIDDEN = ("script", "style", "noscript", "template")
LINKS = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
ATTRIBUTE = re.compile(r"""(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""")
#: What stands between a tag's name and its end: no value, or a value with its quotes. The first group is the end.
INSIDE = re.compile(r"""[^=>]*+(?:(>)|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))""")
BLANKS = re.compile(r"[ \t\r\f\v]+")
LINES = re.compile(r" ?\n[ \n]*")
CHARSET = re.compile(rb"""<meta\b[^>]{0,500}?\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)
HEADER_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.IGNORECASE)
#: Bytes at the start of a page among which it can name its character set.
DECLARED_WITHIN = 4096
#: Character sets that pages may name, by their names in Python. Fixed values.
CHARSETS = frozenset(
    "ascii utf-8 utf-16 utf-16-le utf-16-be iso8859-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16"
    " cp866 cp874 tis-620 cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 koi8-r koi8-u mac-roman mac-cyrillic"
    " gb2312 gbk gb18030 big5 big5hkscs euc_jp iso2022_jp shift_jis cp932 euc_kr cp949".split()
)
#: Bytes that the encodings of a payload may grow to; beyond, the response has an error row.
MOST_INFLATED = 256 << 20
BYTE_ORDER_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; the block digest and length are added. Line ends within values become spaces."""
    fields = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {' '.join(v.splitlines())}".encode() for k, v in fields)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(data: bytes) -> tuple[list[tuple[str, str]], int]:
    """Header fields after a first line, and where the body begins."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], end + 4


def response(page_id: int | None, url: str | None, body: bytes) -> bytes:
    """The response record of a captured page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    date = (EPOCH + timedelta(seconds=abs(page_id or 0) % 31_536_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body))]
    return record(fields, http)


def dechunked(data: bytes) -> bytes:
    """The content of a chunked transfer."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("wrong chunk")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def inflated(data: bytes, wbits: int, members: bool) -> bytes:
    """A compressed payload, all its members if it may have several; ValueError where it is cut short, too long, or not all of it is compressed."""
    out, total = [], 0
    while True:
        d = zlib.decompressobj(wbits)
        out.append(d.decompress(data, MOST_INFLATED + 1 - total))
        total += len(out[-1])
        if total > MOST_INFLATED:
            raise ValueError("payload too long")
        if not d.eof:
            raise ValueError("payload cut short")
        data = d.unused_data
        if not data.strip(b"\0"):  # padding
            return b"".join(out)
        if not members:
            raise ValueError("more than the payload")


def content(body: bytes, http: dict[str, str]) -> bytes:
    """A payload without transfer and content encodings; http has lower-case names."""
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = dechunked(body)
    for coding in reversed([x.strip().lower() for x in http.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            body = inflated(body, 31, True)
        elif coding == "deflate":
            body = inflated(body, 15 if body[:1] == b"\x78" else -15, False)
        elif coding not in ("", "identity"):
            raise ValueError(f"unknown content encoding {coding}")
    return body


def declared_charset(data: bytes) -> str | None:
    m = CHARSET.search(data, 0, DECLARED_WITHIN)
    return m[1].decode() if m else None


def decoded(data: bytes, http: dict[str, str]) -> str:
    """The characters of a page."""
    for mark, charset in BYTE_ORDER_MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(charset, "replace")
    m = HEADER_CHARSET.search(http.get("content-type", ""))
    for charset in (m[1] if m else None, declared_charset(data)):
        try:
            if charset and codecs.lookup(charset).name in CHARSETS:
                return data.decode(charset, "replace")
        except LookupError:
            pass
    return data.decode("utf-8", "replace")


class Markup:
    """What one walk over the markup of a page finds: visible text, title, language and links."""

    def __init__(self, page: str):
        self.page = page
        self.lower = page.encode("utf-8", "replace").lower().decode()  # of bytes: A-Z only, so places stay
        self.parts: list[str] = []
        self.links: list[dict[str, str]] = []
        self.title: str | None = None
        self.lang: str | None = None
        self._walk()

    def text(self) -> str:
        """Visible text, a line for each block."""
        return LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(self.parts)))).strip()

    def _after(self, closer: str, at: int) -> int:
        end = self.lower.find(closer, at)
        return len(self.page) if end < 0 else end

    def _end(self, at: int) -> int:
        """Where a tag ends, from behind its name: the first `>` that is in no quoted value; -1 if there is none."""
        while (m := INSIDE.match(self.page, at)) and not m[1]:
            at = m.end()
        return m.start(1) if m else -1

    def _walk(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            tag = page.find("<", at)
            if tag < 0:
                tag = n
            self.parts.append(page[at:tag])
            if tag == n:
                return
            if page.startswith("<!--", tag):
                self.parts.append(" ")
                at = self._after("-->", tag + 4) + 3
                continue
            closing = page.startswith("/", tag + 1)
            m = NAME.match(page, tag + 1 + closing)
            if m is None and not closing and not page.startswith("!", tag + 1):
                self.parts.append("<")
                at = tag + 1
                continue
            end = self._end(m.end()) if m else page.find(">", tag)
            if end < 0:  # a tag that is never closed is text, and so is all behind it
                self.parts.append(page[tag:])
                return
            at = end + 1
            name = m[0].lower() if m else ""
            self.parts.append("\n" if name in BLOCKS else " ")
            if closing or not name:
                continue
            if name in LINKS or name == "html":
                self._attributes(name, page[m.end() : end])
            if name == "title" and self.title is None:
                self.title = html.unescape(page[at : self._after("</title", at)]).strip()
            if name in HIDDEN:
                close = self._after(f"</{name}", at)
                at = self._after(">", close) + 1

    def _attributes(self, name: str, inside: str) -> None:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(inside):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if name == "html":
            self.lang = self.lang or found.get("lang")
        elif LINKS[name] in found:
            self.links.append({"tag": name, "url": found[LINKS[name]]})


def plain_text(page: str) -> str:
    return Markup(page).text()


def envelope(markup: Markup, charset: str | None, fields: dict[str, str], http: list[tuple[str, str]], status: str) -> bytes:
    """What a metadata record holds, as JSON."""
    source = {k: fields.get(k) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Block-Digest", "WARC-Payload-Digest")}
    page = {"title": markup.title, "lang": markup.lang, "charset": charset, "links": markup.links}
    return json.dumps({"source": source, "http": {"status": status, "headers": http}, "html": page}, ensure_ascii=False, separators=(",", ":")).encode()


def derive(source: bytes) -> list[tuple[str, dict[str, str], bytes]]:
    """(kind, headers, record) of what is derived from a response record. ValueError if it is none."""
    if not source.startswith(VERSION + b"\r\n"):
        raise ValueError("no WARC record")
    listed, at = headers_of(source)
    fields = dict(listed)
    block = source[at : at + int(fields["Content-Length"])]
    if fields.get("WARC-Type") != "response" or digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError("no response, or a wrong digest")
    http, body_at = headers_of(block)
    body = block[body_at:]
    payload = digest(body)
    if payload != fields.get("WARC-Payload-Digest", payload):
        raise ValueError("wrong payload digest")
    by_name = {k.lower(): v for k, v in http}
    data = content(body, by_name)
    markup = Markup(decoded(data, by_name))
    status = block[: block.index(b"\r\n")].decode("latin-1")
    out = []
    for kind, mime, made in (("metadata", "application/json", envelope(markup, declared_charset(data), fields, http, status)), ("conversion", "text/plain; charset=utf-8", markup.text().encode("utf-8", "replace"))):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, fields["WARC-Record-ID"])), ("WARC-Date", fields["WARC-Date"]), ("WARC-Target-URI", fields.get("WARC-Target-URI", "")), ("WARC-Refers-To", fields["WARC-Record-ID"]), ("WARC-Refers-To-Target-URI", fields.get("WARC-Target-URI", "")), ("WARC-Refers-To-Date", fields["WARC-Date"]), ("WARC-Source-Payload-Digest", payload), ("Content-Type", mime)]
        full = record(own, made)
        out.append((kind, dict(own) | {"WARC-Block-Digest": digest(made), "Content-Length": str(len(made))}, full))
    return out


SCHEMA = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, n_bytes long, record binary"


def _derive_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    names = ["WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Source-Payload-Digest", "WARC-Block-Digest"]
    out = [[] for _ in range(10)]
    for page_id, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        try:
            made = derive(source or b"")
        except (ValueError, KeyError, zlib.error):
            made = [("error", {}, b"")]
        for kind, fields, full in made:
            for column, value in zip(out, (page_id, kind, *(fields.get(n) for n in names), int(fields.get("Content-Length", 0)), full), strict=True):
                column.append(value)
    kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record of every page."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [response(p, u, b) for p, u, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), null_safe_bytes(batch.column(2)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), kernel, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of response records (page_id, record), and the fields that link them."""
    return map_arrow(records.select("page_id", "record"), _derive_batch, SCHEMA)
