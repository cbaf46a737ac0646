import gzip
import hashlib
import json
import re
import zlib
from html.parser import HTMLParser

import pytest

from glasswing.llm import queries, warc

PAGE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nServer: s\r\n\r\n<title>T&amp;\xe9</title><script>var a='<p>';</script><p>One <b>two</b></p><!-- no --><a href='/x?a=1&amp;b=2'>L</a>"


def test_records_are_linked_and_keep_what_the_response_has():
    head = [("WARC-Payload-Digest", "sha1:ABC"), ("WARC-Warcinfo-ID", "<urn:uuid:w>")]
    meta, text = warc.derived("<urn:uuid:r>", "http://u/", "2020-01-01T00:00:00Z", head, PAGE)
    for r in (meta, text):
        own = dict(r["headers"])
        assert own["WARC-Refers-To"] == "<urn:uuid:r>" and own["WARC-Source-Payload-Digest"] == "sha1:ABC" and own["WARC-Warcinfo-ID"] == "<urn:uuid:w>"
        assert own["WARC-Block-Digest"] == warc.digest(r["block"]) and (r["uri"], r["date"]) == ("http://u/", "2020-01-01T00:00:00Z")
    assert text["block"].decode() == "T&é\nOne two\nL"
    fields = meta["block"].decode()
    assert "source-http-server: s\r\n" in fields and "outlink: /x?a=1&b=2 L a/@href\r\n" in fields and "source-warc-payload-digest: sha1:ABC" in fields


@pytest.mark.parametrize("page", ["", "<", "<" * 50_000, "<!--" * 20_000, "<script>" * 5_000, "a < b > c", "<p>" + "x" * 100_000])
def test_awkward_pages(page):
    assert isinstance(warc.plain_text(page), str) and isinstance(warc.links(page), list)


def test_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, None), (None, "u", ""), (3, "http://b/", "é" * 100_000)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    names = warc.write(made.repartition(2), f"file://{tmp_path}/w")
    back = [r for n in names for r in warc.read(f"file://{tmp_path}/w", n)]
    want = {(r.record_id, r.type, r.uri, bytes(r.block)) for r in made.collect()}
    assert {(r["record_id"], r["type"], r["uri"], r["block"]) for r in back} == want and len(back) == 10


def test_other_types_and_empty_tables(spark):
    rows = warc.responses(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    assert warc.derive(rows.limit(0)).count() == 0
    assert warc.derive(rows.selectExpr("record_id", "'request' AS type", "uri", "date", "headers", "block")).count() == 0
    assert warc.derive(rows.selectExpr("record_id", "type", "uri", "date", "null AS headers", "null AS block").selectExpr("record_id", "type", "uri", "date", "cast(headers AS array<struct<name:string,value:string>>) AS headers", "cast(block AS binary) AS block")).count() == 2


def test_query_has_two_records_for_each_page(spark, sf_dir):
    out = queries.op3_warc(spark, sf_dir).collect()
    assert len(out) == 2 * spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert len({r.record_id for r in out}) == len(out)


def chunked(data, size):
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\nTrailer: x\r\n\r\n"


@pytest.mark.parametrize("coding", ["gzip", "deflate", "bare", "gzip, deflate", "br", None])
@pytest.mark.parametrize("transfer", [True, False])
def test_codings_of_payloads(coding, transfer):
    page, head = "<p>naïve text</p>".encode(), [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    bare = zlib.compressobj(wbits=-15)
    made = {"gzip": gzip.compress(page), "deflate": zlib.compress(page), "bare": bare.compress(page) + bare.flush(), "gzip, deflate": zlib.compress(gzip.compress(page)), "br": b"\x8b\x00", None: page}[coding]
    if coding:
        head.append(b"Content-Encoding: " + {"bare": "deflate"}.get(coding, coding).encode())
    if transfer:
        head.append(b"Transfer-Encoding: chunked")
        made = chunked(made, 7)
    meta, text = warc.derived("<urn:uuid:r>", "u", "d", [], b"\r\n".join(head) + b"\r\n\r\n" + made)
    assert text["block"].decode() == ("naïve text" if coding != "br" else "�\x00".strip())
    assert dict(meta["headers"])["WARC-Source-Payload-Digest"] == warc.digest(made)  # that of the payload as it was sent
    assert warc.unchunked(b"5\r\nab") == b"ab" and warc.unchunked(b"zz\r\n") == b"" and warc.inflated(b"no", "gzip") == b"no"


class Plain(HTMLParser):
    """Another reading of pages: text outside hidden elements, a line for each block, targets of links."""

    BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
    HIDDEN = set("script style noscript template".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.deep = "", [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.deep += tag in self.HIDDEN
        self.text += "\n" * (tag in self.BLOCKS) + " " * (tag in self.HIDDEN)
        if tag == "a" and not self.deep and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        self.deep -= tag in self.HIDDEN
        self.text += "\n" * (tag in self.BLOCKS)

    def handle_comment(self, data):
        self.text += " "

    def handle_data(self, data):
        self.text += "" if self.deep else data


def test_query_against_another_parser(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op3_warc(spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r.page_id]
        body = page.html or ""
        want, own = Plain(body), {h["name"]: h["value"] for h in json.loads(r.headers)}
        assert (r.uri, r.source_payload_digest) == (page.url, "sha256:" + hashlib.sha256(body.encode()).hexdigest())
        assert r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode())
        assert own["WARC-Warcinfo-ID"].startswith("<urn:uuid:") and own["WARC-Refers-To"] == r.refers_to and own["WARC-Refers-To-Target-URI"] == page.url
        if r.type == "conversion":
            lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in want.text.splitlines())
            assert r.content == "\n".join(x for x in lines if x)
        else:
            fields = [tuple(x.split(": ", 1)) for x in r.content.split("\r\n") if x]
            assert [v for k, v in fields if k == "outlink"] == [f"{' '.join(x.split())} L a/@href" for x in dict.fromkeys(want.links)]
            assert ("source-http-status", "200 OK") in fields and ("source-warc-payload-digest", r.source_payload_digest) in fields
    assert len({r.refers_to for r in rows}) == len(pages)


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "a", "b")], "page_id long, url string, html string, block string, type string")
    rows = warc.responses(pages).withColumn("extra", warc.F.lit(1))
    assert set(warc.derive(rows, key="page_id").columns) == {"page_id", "record_id", "type", "uri", "date", "headers", "block"}


def test_all_members_of_a_gzip_payload_and_what_follows_them():
    both = gzip.compress(b"one ") + gzip.compress(b"two")
    assert warc.inflated(both, "gzip") == b"one two" and warc.inflated(both + b"\0\0\0", "x-gzip") == b"one two"
    assert warc.inflated(b"plain", "gzip") == b"plain" and warc.inflated(b"", "gzip") == b""


def test_types_in_any_case_and_headers_that_end_in_a_bare_lf():
    for end in (b"\n", b"\r\n"):
        block = end.join([b"HTTP/1.1 200 OK", b"Content-Type: TEXT/HTML; Charset=UTF-8", b"", b"<p>Hi</p><p>you</p>"])
        meta, text = warc.derived("id", "u", "d", [], block)
        assert text["block"] == b"Hi\nyou" and b"source-http-status: 200 OK\r\n" in meta["block"]
    assert warc.split_http(b"HTTP/1.1 204 No Content\r\nA: b")[1:] == ([("A", "b")], b"")
