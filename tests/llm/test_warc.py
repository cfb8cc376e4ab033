import base64
import gzip
import hashlib
import json
import random
import re
import time

from pyspark.sql import functions as F

from riverframe.llm import warc

SF = "/root/testdata/sf0.01"


def test_derivatives_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    responses = {r.record_id: r for r in warc.responses_of(pages).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(responses) == len(html)
    rows = warc.op9_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(html) and len({r.record_id for r in rows}) == len(rows)
    kinds = {}
    for r in rows:
        source = responses[r.refers_to]
        body = html[source.page_id].encode()
        kinds.setdefault(r.refers_to, set()).add(r.type)
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.target_uri == source.target_uri and r.payload_digest == sha(body) and r.block_digest == sha(r.block.encode())
        assert r.content_length == len(r.block.encode()) and ["Content-Length", str(len(body))] in json.loads(r.source_headers)
        if r.type == "metadata":
            meta = json.loads(r.block)
            assert meta["status"] == 200 and meta["payload_length"] == len(body)
        else:
            assert "<script" not in r.block and "</p>" not in r.block
    assert all(k == {"metadata", "conversion"} for k in kinds.values())


def test_text_and_links():
    page = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><p>One<br>two</p><script>var a='<p>';</script><!-- no --><a href='/x?a=1&amp;b=2'>go</a> now</body></html>"
    meta, text = warc.derived("<id>", "u", "d", b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\n" + page.encode())
    assert text[-1].decode() == "One\ntwo\ngo now"
    found = json.loads(meta[-1])
    assert (found["status"], found["title"], found["links"], found["headers"]) == (404, "A & B", ["/x?a=1&b=2"], [["X", "y"]])


def test_round_trip_of_files(spark, tmp_path):
    records = warc.derive(warc.responses_of(spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (3, "u", "x" * 100_000)], "page_id bigint, url string, html string")))
    rows = [r.asDict() for r in records.collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.serialize, rows)))
    back = [r.asDict() for r in warc.read_records(spark, str(tmp_path / "a.warc")).collect()]
    assert [{**r, "source_headers": None} for r in rows] == back
    warc.write_records(records, str(tmp_path / "out"))
    written = b"".join(bytes(r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert sorted(x["record_id"] for x in warc.parse(written)) == sorted(r["record_id"] for r in rows)


def test_odd_rows(spark):
    odd = spark.createDataFrame([("<a>", None, None, None, "x"), ("<a>", "u", "d", b"no head", "x"), ("<b>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nope\r\n\r\nhi", "x")], "record_id string, target_uri string, date string, block binary, type string")
    got = warc.derive(odd).collect()
    assert len(got) == 6
    assert {bytes(r.block).decode() for r in got if r.type == "conversion"} == {"", "no head", "hi"}
    assert warc.derive(odd.limit(0)).count() == 0
    assert warc.derive(odd).filter(F.col("record_id").isNull()).count() == 0


def by_patterns(page):
    """The plain text by whole-page patterns, which are right but quadratic on broken pages."""
    text = re.sub(r"<!--.*?-->|<(script|style|noscript|template|head)\b.*?</\1\s*>", " ", page, flags=re.S | re.I)
    text = re.sub(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre|title|body|main)\b[^>]*>", "\n", text, flags=re.I)
    import html

    lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))
    return "\n".join(x for x in lines if x)


def test_text_equals_patterns_on_every_page(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert warc.scan(r.html or "")[0] == by_patterns(r.html or "")
    r = random.Random(4)
    parts = ["<p>", "</p>", "a b", "<br/>", "<script>x</script>", "<!-- c -->", "&amp;", "<a href=x>", "</a>", "<STYLE>y</style >", "<b>", "\n", "<h1 id='q'>", "é"]
    for _ in range(300):
        page = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert warc.scan(page)[0] == by_patterns(page)


def test_broken_pages_take_linear_time():
    for part in ("<a ", "<!--", "<", "<script", "<title", "<script>", "<a href='", "</script "):
        began = time.time()
        warc.scan(part * 200_000)
        warc.title_of(part * 200_000)
        assert time.time() - began < 5


def test_damaged_files_are_told(spark, tmp_path):
    rows = [r.asDict() for r in warc.derive(warc.responses_of(spark.createDataFrame([(1, "u", "<p>one</p>"), (2, "v", "two")], "page_id bigint, url string, html string"))).collect()]
    whole = [warc.serialize(r) for r in rows]
    ids = [r["record_id"] for r in rows]
    for data, want in (
        (b"".join(whole), ids),
        (whole[0] + b"junk here\r\n" + whole[1], [ids[0], None, ids[1]]),
        (whole[0] + whole[1][:-30], [ids[0], None]),
        (b"WARC/1.1\r\nContent-Length: x\r\n\r\nrest\r\n" + whole[2], [None, ids[2]]),
        (b"WARC/1.1\r\nWARC-Type: \xff\r\nContent-Length: 2\r\n\r\nok\r\n\r\n", [None]),
        (b"", []),
    ):
        assert [r["record_id"] for r in warc.parse(data)] == want
    assert [r["type"] for r in warc.parse(whole[0] + b"junk")] == [rows[0]["type"], "unreadable"]
    packed = gzip.compress(whole[0]) + gzip.compress(whole[1])
    (tmp_path / "cut.warc.gz").write_bytes(packed[:-12])
    got = warc.read_records(spark, str(tmp_path / "cut.warc.gz")).collect()
    assert got[0].record_id == ids[0] and got[-1].type == "unreadable"
