import base64
import gzip
import hashlib
import json
from html.parser import HTMLParser

from hypothesis import given
from hypothesis import strategies as st

from docledger.llm import warc

PAGES = [
    (1, "http://a.example/x", '<html><head><title>T &amp; u</title><script>var a="</p>";</script></head><body><!-- no --><h1>Head</h1><p>One<br>two <a href="/l?a=1&amp;b=2">link <b>text</b></a><p>Three'),
    (2, None, None),
    (3, "http://b.example", ""),
    (4, "http://c.example", "a < b and <3 <unclosed"),
    (5, "http://d.example", "<script>never ends"),
    (1, "http://a.example/x", "again"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")


def test_text_title_and_links():
    title, text, links = warc.extract(PAGES[0][2])
    assert title == "T & u"
    assert text == "T & u\nHead\nOne\ntwo link text\nThree"
    assert links == [("/l?a=1&b=2", "link text")]
    assert warc.extract(PAGES[3][2])[1] == "a < b and <3"
    assert warc.extract(PAGES[4][2])[1] == ""


@given(st.text(alphabet="<>/ab!-& \"'=\n", max_size=80))
def test_no_page_fails(t):
    warc.extract(t)


def test_round_trip_links_and_digests(spark):
    resp = warc.responses_of_pages(pages(spark))
    source = {r.record_id: r for r in resp.collect()}
    out = warc.derivatives(resp, "page_id").collect()
    assert len(out) == 2 * len(PAGES)
    for r in out:
        rid = r.headers["WARC-Refers-To"]
        s = source[rid]
        assert r.headers.get("WARC-Target-URI") == s.headers.get("WARC-Target-URI")
        assert r.headers["WARC-Date"] == s.headers["WARC-Date"]
        assert r.headers["WARC-Source-Payload-Digest"] == s.headers["WARC-Payload-Digest"]
        assert r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        assert int(r.headers["Content-Length"]) == len(r.block)
        if r.type == "metadata":
            body = json.loads(bytes(r.block))
            assert body["refers-to"] == rid and body["source-digests"]["block"] == s.headers["WARC-Block-Digest"]
    pair = [r for r in out if r.headers["WARC-Refers-To"] == out[0].headers["WARC-Refers-To"]]
    assert {r.headers["WARC-Concurrent-To"] for r in pair} == {r.record_id for r in pair}


def test_files_read_back(spark, tmp_path):
    resp = warc.responses_of_pages(pages(spark))
    out = warc.derivatives(resp, "page_id").drop("key")
    for k, r in enumerate(warc.files(out.unionByName(resp.drop("page_id")).coalesce(2), file_bytes=500).collect()):
        (tmp_path / f"{k}-{r.name}").write_bytes(bytes(r.content))
        assert gzip.decompress(bytes(r.content)).startswith(b"WARC/1.0\r\n")
    back = warc.read_warc(spark, str(tmp_path))
    want = sorted((r.record_id, r.type, sorted(r.headers.items()), bytes(r.block)) for r in out.unionByName(resp.drop("page_id")).collect())
    assert sorted((r.record_id, r.type, sorted(r.headers.items()), bytes(r.block)) for r in back.collect()) == want
    again = warc.derivatives(back)
    assert sorted(r.record_id for r in again.collect()) == sorted(r.record_id for r in out.collect())


def test_defined_cases(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string, block string, type int")
    assert warc.digest_rows(none).count() == 0
    rows = spark.createDataFrame([("<x>", "request", {"A": "b"}, b"q"), (None, "response", None, None), ("<y>", "response", {"WARC-Date": "d"}, b"no http head")], warc.RECORD)
    got = warc.derivatives(rows).collect()
    assert len(got) == 4
    assert [bytes(r.block) for r in got if r.headers["WARC-Refers-To"] == "<y>" and r.type == "conversion"] == [b"no http head"]


def test_charsets_that_decode_no_text():
    for name in ("idna", "undefined", "x\0y", "hex", "nope", "", "utf-8"):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + name.encode() + b"\r\n\r\n<p>one \xff two"
        text = warc.derive("<r>", {}, block)[1][3].decode()
        assert text.startswith("one ") and text.endswith(" two")
    assert warc.derive("<r>", {}, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9")[1][3].decode() == "é"


def test_repeated_headers_are_kept():
    one = {"WARC-Type": "response", "WARC-Concurrent-To": "<b>\n<c>", "Content-Length": "2"}
    data = warc.serialise(one, b"ab")
    assert data.count(b"WARC-Concurrent-To: ") == 2
    assert list(warc.parse(data)) == [(one, b"ab")]
    http = warc.split_http(b"HTTP/1.1 200 OK\r\nVary: a\r\nvary: b\r\n\r\n")[1]
    assert http == {"Vary": "a, b"}


def test_broken_records_become_problems(spark, tmp_path):
    good = warc.serialise({"WARC-Type": "response", "WARC-Record-ID": "<a>", "Content-Length": "3"}, b"xyz")
    bad = b"WARC/1.0\r\nContent-Length: abc\r\n\r\nxx\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good + bad + good)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-12])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(good[:-6])
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(good) + b"garbage")
    back = warc.read_warc(spark, str(tmp_path))
    got = sorted((r.type, r.record_id, bytes(r.block)) for r in back.collect() if r.type == "response")
    assert got == [("response", "<a>", b"xyz")] * 4
    told = {r.headers["Problem"].split(":")[0] for r in back.collect() if r.type == "problem"}
    assert told == {"Content-Length", "0 of 3 bytes", "EOFError", "1 of 3 bytes", "BadGzipFile"}
    assert warc.derivatives(back).count() == 8


class Plain(HTMLParser):
    """Text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in warc.SKIPPED
        self.parts.append("\n" if tag in warc.BREAKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in warc.SKIPPED
        self.parts.append("\n" if tag in warc.BREAKS else "")

    def handle_data(self, data):
        self.parts.append("" if self.skip else data)


def test_whole_table_against_another_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {(r.page_id, r.type): r for r in warc.digest_rows(df).collect()}
    pages = df.collect()
    assert len(out) == 2 * len(pages)
    for p in pages:
        parser = Plain()
        parser.feed(p.html)
        parser.close()
        lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
        r = out[(p.page_id, "conversion")]
        assert r.block == "\n".join(x for x in lines if x)
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.target_uri == p.url and r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == out[(p.page_id, "metadata")].source_payload_digest == sha(p.html.encode())
        assert r.refers_to == out[(p.page_id, "metadata")].refers_to
