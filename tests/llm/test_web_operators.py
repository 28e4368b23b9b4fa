import base64
import datetime
import gzip
import hashlib
import json
import time
import zlib

import pytest

from tessera.llm import urlfilter, warc

PAGE = '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><script>var x = "</p>";</script></head><body><a href="/a?x=1&amp;y=2">go</a><p>One  two</p><!-- no --><p>&lt;three&gt;</p></body></html>'


def test_derivatives_are_linked():
    source = warc.response(7, "http://example.com/", PAGE.encode())
    fields, at = warc.headers_of(source)
    fields = dict(fields)
    body_digest = "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert fields["WARC-Payload-Digest"] == body_digest
    made = {kind: (head, full) for kind, head, full in warc.derive(source)}
    assert set(made) == {"metadata", "conversion"}
    for kind, (head, full) in made.items():
        own, start = warc.headers_of(full)
        own = dict(own)
        block = full[start : start + int(own["Content-Length"])]
        assert full == full[:start] + block + b"\r\n\r\n"
        assert own["WARC-Type"] == kind and own["WARC-Refers-To"] == fields["WARC-Record-ID"]
        assert own["WARC-Target-URI"] == fields["WARC-Target-URI"] and own["WARC-Source-Payload-Digest"] == body_digest
        assert own["WARC-Block-Digest"] == warc.digest(block) == head["WARC-Block-Digest"]
        made[kind] = block
    assert made["conversion"].decode() == "A & B\ngo\nOne two\n<three>"
    meta = json.loads(made["metadata"])
    assert meta["html"] == {"title": "A & B", "lang": "en", "charset": None, "links": [{"tag": "a", "url": "/a?x=1&y=2"}]}
    assert ["Content-Type", "text/html; charset=utf-8"] in meta["http"]["headers"] and meta["source"]["WARC-Record-ID"] == fields["WARC-Record-ID"]
    assert warc.derive(source) == warc.derive(source)


def test_broken_records_are_errors(spark):
    good = warc.response(1, None, b"")
    rows = [(1, bytearray(good)), (1, bytearray(good)), (2, bytearray(good[:-10] + b"tampered\r\n")), (3, bytearray(b"junk")), (4, None), (5, bytearray(good.replace(b"200 OK", b"404 NO")))]
    got = [(r["page_id"], r["kind"]) for r in warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()]
    assert sorted(got) == sorted([(1, "metadata"), (1, "conversion")] * 2 + [(2, "error"), (3, "error"), (4, "error"), (5, "error")])


def encoded(body, *headers):
    http = b"\r\n".join([b"HTTP/1.1 200 OK", *headers]) + b"\r\n\r\n" + body
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", warc.digest(body))], http)


def converted(source):
    [full] = [full for kind, _, full in warc.derive(source) if kind == "conversion"]
    return full[warc.headers_of(full)[1] :].decode().strip()


def test_payloads_are_decoded():
    page = "<title>é</title><p>Größe ñ</p>"
    utf8, latin = page.encode(), page.encode("latin-1")
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(utf8[i : i + 7]), utf8[i : i + 7]) for i in range(0, len(utf8), 7)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    want = "é\nGröße ñ"
    assert converted(encoded(utf8)) == want
    assert converted(encoded(gzip.compress(utf8), b"Content-Encoding: gzip")) == want
    assert converted(encoded(zlib.compress(utf8), b"content-encoding: deflate")) == want
    assert converted(encoded(raw.compress(utf8) + raw.flush(), b"content-encoding: deflate")) == want
    assert converted(encoded(chunked, b"Transfer-Encoding: chunked")) == want
    assert converted(encoded(latin, b"Content-Type: text/html; charset=ISO-8859-1")) == want
    assert converted(encoded(b'<meta charset="latin1">' + latin)) == want
    assert converted(encoded(b"\xff\xfe" + page.encode("utf-16-le"))) == want
    assert converted(encoded(utf8, b"Content-Type: text/html; charset=nonsense")) == want
    for bad in (encoded(b"plain", b"Content-Encoding: gzip"), encoded(b"zz\r\n", b"Transfer-Encoding: chunked"), encoded(utf8, b"Content-Encoding: br")):
        with pytest.raises((ValueError, zlib.error)):
            warc.derive(bad)


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<p", "<title>", "<a href=x ", "<", "&", "</", "a" * 40])
def test_markup_is_walked_once(piece):
    page = piece * (160_000 // len(piece))
    began = time.process_time()
    warc.Markup(f"<a {page}>{page}").text()
    assert time.process_time() - began < 2


def test_hidden_and_broken_markup():
    assert warc.plain_text("a<style>x</STYLE >b<br/>c<template>d</template>1 < 2 <3 <!doctype x>e<script>never closed") == "a b\nc 1 < 2 <3 e"


def test_pages_of_one_id(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>b"), (1, "u", "<p>" + "long text " * 100_000)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len({r["record_id"] for r in rows}) == len(rows) == 6


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "http://a/", "<p>x", "y")], "page_id long, url string, html string, record string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 4 and all(r["refers_to"] for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


D = lambda n: datetime.date(2024, 1, n)


def test_intervals(spark):
    events = [("l", "k", "add", D(1)), ("l", "k", "add", D(3)), ("l", "k", "remove", D(5)), ("l", "k", "remove", D(6)), ("l", "k", "add", D(8)), ("l", "other", "remove", D(1)), ("l", "tie", "add", D(2)), ("l", "tie", "remove", D(2))]
    got = urlfilter.intervals(spark.createDataFrame(events, "list string, key string, action string, day date")).collect()
    assert sorted((r["key"], r["since"], r["until"]) for r in got) == [("k", D(1), D(5)), ("k", D(8), datetime.date(9999, 12, 31))]


def test_captures_as_of_their_date(spark):
    events = [("hosts", "domain:example.com", "add", D(3)), ("hosts", "domain:example.com", "remove", D(6)), ("paths", "prefix:www.example.com/a/b", "add", D(1))]
    captures = [
        (1, "https://User@WWW.Example.com:80/x?q", D(2), 0), (2, "https://www.example.com/x", D(3), 0), (3, "https://www.example.com/x", D(5), 0), (4, "https://www.example.com/x", D(6), 0),
        (5, "http://www.example.com/a/b/c#f", D(4), 0), (6, "http://www.example.com/a/bc", D(9), 0), (7, None, D(4), 0), (8, "not a url", D(4), 0), (9, "http://example.com", None, 0), (10, "http://notexample.com/", D(4), 0), (None, "http://example.com", D(4), 0), (3, "https://www.example.com/x", D(5), 0),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date, n long")
    e = spark.createDataFrame(events, "list string, key string, action string, day date")
    got = sorted(((r["page_id"], r["n_entries"], r["lists"]) for r in urlfilter.evaluate(c, e).collect()), key=str)
    want = {2: (1, "hosts"), 3: (1, "hosts"), 5: (2, "hosts,paths"), None: (1, "hosts")}
    assert got == sorted(((r[0], *want.get(r[0], (0, ""))) for r in captures), key=str)
    assert urlfilter.evaluate(c.limit(0), e).count() == 0
    assert urlfilter.evaluate(c, e.limit(0)).where("blocked").count() == 0


def test_quoted_values_may_hold_the_end_of_a_tag():
    m = warc.Markup('<a title="1 > 0" href="http://x/">go</a><img alt=\'a>b\' src=y.png>x<a href=p="q>r</a>')
    assert m.links == [{"tag": "a", "url": "http://x/"}, {"tag": "img", "url": "y.png"}, {"tag": "a", "url": 'p="q'}] and m.text() == "go x r"
    assert warc.Markup('<p>a<b title="never closed>c').text().startswith("a")


@pytest.mark.parametrize("seed", range(30))
def test_links_and_text_by_html_parser(seed):
    """Against the standard library's parser on random markup."""
    import random
    from html.parser import HTMLParser

    r = random.Random(seed)
    value = lambda: "".join(r.choice("ab>/= &'1") for _ in range(r.randint(0, 6))).replace("'", "" if r.random() < 0.5 else "x")
    attribute = lambda n: r.choice((f'{n}="{value()}"', f"{n} = '{value()}'", f"{n}=v{r.randint(0, 9)}", "data-x", f'title="{value()}"'))
    page = "".join(r.choice((lambda: f"<a {attribute('href')} {attribute('rel')}>t{r.randint(0, 9)}</a>", lambda: f"<img {attribute('alt')} {attribute('src')}/>", lambda: "<p>w</p>", lambda: "1 < 2 ", lambda: "<!-- <a href=n> -->"))() for _ in range(40))

    class Parser(HTMLParser):
        found, words = [], []

        def handle_starttag(self, tag, attrs):
            first = dict(reversed(attrs))
            if warc.LINKS.get(tag) in first:
                self.found.append({"tag": tag, "url": first[warc.LINKS[tag]] or ""})

        def handle_data(self, data):
            self.words.append(data)

    p = Parser()
    p.found, p.words = [], []
    p.feed(page)
    p.close()
    m = warc.Markup(page)
    assert m.links == p.found and "".join(m.text().split()) == "".join("".join(p.words).split())


def test_members_limits_and_character_sets(monkeypatch):
    import gzip
    import zlib

    two = gzip.compress(b"aaa") + gzip.compress(b"bbb") + b"\0" * 5
    assert warc.content(two, {"content-encoding": "gzip"}) == b"aaabbb"
    for coding, bad in (("gzip", two[:-12]), ("gzip", gzip.compress(b"a") + b"more"), ("deflate", zlib.compress(b"a") + b"x")):
        with pytest.raises((ValueError, zlib.error)):
            warc.content(bad, {"content-encoding": coding})
    monkeypatch.setattr(warc, "MOST_INFLATED", 1000)
    assert len(warc.content(gzip.compress(b"x" * 1000), {"content-encoding": "gzip"})) == 1000
    with pytest.raises(ValueError):
        warc.content(gzip.compress(b"x" * 600) * 2, {"content-encoding": "gzip"})
    assert warc.decoded(b"\\u0041", {"content-type": "text/html; charset=unicode_escape"}) == "\\u0041"
    assert warc.decoded(b"\xe9", {"content-type": "text/html; charset=latin1"}) == "é"
