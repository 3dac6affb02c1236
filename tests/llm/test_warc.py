import glob
import gzip
import hashlib
import re

from pyspark.sql import functions as F

from storyloom.llm import warc

DATE = "2024-01-01T00:00:00Z"


def parse(raw):
    """Records of a WARC file, by Content-Length."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in head[1:])
        size = int(fields["Content-Length"])
        out.append((fields, raw[end + 4:end + 4 + size]))
        at = end + 4 + size
        assert raw[at:at + 4] == b"\r\n\r\n"
        at += 4
    return out


def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def test_linked_records(spark):
    source = warc.responses_from_pages(pages(spark), DATE)
    responses = {r.page_id: r for r in source.collect()}
    rows = warc.derivatives(source).collect()
    assert len(rows) == 2 * len(responses) and len({r.record_id for r in rows}) == len(rows)
    html = {r.page_id: r.html for r in pages(spark).collect()}
    for r in rows:
        assert r.refers_to == responses[r.page_id].record_id and r.target_uri == responses[r.page_id].target_uri
        assert r.source_digest == "sha256:" + hashlib.sha256(html[r.page_id].encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
        assert r.source_headers.startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html")
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
    text = next(r.block for r in rows if r.record_type == "conversion" and r.page_id == 0)
    assert "track(" not in text and "<" not in text and "margin" not in text and " ad 0 " not in text


def test_written_files_parse(spark, tmp_out):
    rows = warc.derivatives(warc.responses_from_pages(pages(spark), DATE))
    warc.write_warc(rows, f"{tmp_out}/w")
    found = [x for f in glob.glob(f"{tmp_out}/w/*.gz") for x in parse(gzip.open(f).read())]
    want = {r.record_id: r for r in rows.collect()}
    assert len(found) == len(want)
    for fields, block in found:
        r = want[fields["WARC-Record-ID"]]
        assert block.decode() == r.block and fields["WARC-Refers-To"] == r.refers_to
        assert fields["WARC-Type"] == r.record_type and fields["WARC-Source-Payload-Digest"] == r.source_digest


def test_conversion(spark):
    html = ("<HTML lang='FR-ca'><head><title> A &amp;\n B </title><STYLE>p{}</STYLE ></head><!-- x\n --><body><p>one"
            "<b>two</b>&lt;&nbsp;three</p><div>four<br/>five  six</div><SCRIPT>if (a</b>) x</SCRIPT>"
            "<a class=x href='u'>link</a></body></html>")
    df = spark.createDataFrame([("r1", "http://x", DATE, "HTTP/1.0 404 Not Found\r\ncontent-type: text/html; x\r\n\r\n" + html)],
                               "record_id string, target_uri string, warc_date string, block string")
    got = {r.record_type: r.block for r in warc.derivatives(df).collect()}
    assert got["conversion"] == "A & B\nonetwo< three\nfour\nfive six\nlink"
    assert got["metadata"].split("\r\n")[:6] == [
        "source-status: 404", "source-content-type: text/html; x", f"source-content-length: {len(html)}",
        "title: A &amp; B", "language: fr-ca", "outlinks: 1"]


def test_odd_rows(spark):
    schema = "record_id string, target_uri string, warc_date string, block string, refers_to string, _head string"
    rows = [("a", None, None, None, "x", "mine"), ("a", None, None, None, "x", "mine"), (None, "u", "d", "", "x", "mine"),
            ("b", "u", "d", "no empty line", "x", "mine"), ("c", "u", "d", "H\r\n\r\n" + "<p>x" * 50_000, "x", "mine")]
    out = warc.derivatives(spark.createDataFrame(rows, schema))
    got = out.collect()
    assert len(got) == 10 and {r._head for r in got} == {"mine"} and {r.refers_to for r in got} == {"a", None, "b", "c"}
    assert next(r for r in got if r.refers_to == "b" and r.record_type == "conversion").block == ""
    assert out.where(F.col("record_id").isNull()).count() == 0
    assert warc.derivatives(spark.createDataFrame([], schema)).count() == 0
    null_page = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses_from_pages(null_page, DATE)).count() == 2


def text_of(spark, pages):
    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses_from_pages(df, DATE)).where("record_type = 'conversion'").collect()
    return [r.block for r in sorted(rows, key=lambda r: r.page_id)]


def test_character_references(spark):
    cases = {"a&#8217;b": "a\u2019b", "&#x27;&#X41;": "'A", "x&mdash;y &eacute;": "x\u2014y \u00e9", "&amp;lt;": "&lt;",
             "&#128512;": "\U0001f600", "a&nbsp;b&#160;c&#10;d": "a b c d", "&#0;&#xD800;&#1114112;": "\ufffd" * 3,
             "&nosuch; &amp &;&#;&#x;&": "&nosuch; &amp &;&#;&#x;&", "&apos;&quot;;": "'\";", "": "", "&&lt;;": "&<;",
             "a < b &gt; c": "a < b > c"}
    assert text_of(spark, cases) == list(cases.values())


def test_references_like_the_standard_library(spark):
    import html
    texts = [f"&{n};x&{n};;" for n in warc.REFERENCES if n != "nbsp"] + [f"&#{c};|&#x{c:x};" for c in range(161, 70_000, 997)
                                                                        if not 0xD800 <= c < 0xE000]
    assert text_of(spark, texts) == [html.unescape(t) for t in texts]


def test_open_ends_cost_in_proportion(spark):
    import time
    pages = ["keep<!-- " * 110_000, "keep<script>" * 80_000, "keep<div " * 110_000, "keep<title" * 100_000,
             "<html <a " * 110_000, "&#" * 300_000]
    text_of(spark, ["warm"])
    start = time.time()
    got = text_of(spark, pages)
    assert time.time() - start < 20
    assert got[:4] == ["keep"] * 4 and got[5] == pages[5]
