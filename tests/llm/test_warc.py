import base64
import hashlib
import json

from pyspark.sql import functions as F

from plumbline.llm import warc


def test_links_and_digests(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = {r.id: r for r in warc.responses_of_pages(pages).collect()}
    rows = warc.derivatives(warc.responses_of_pages(pages)).collect()
    assert len(rows) == 2 * len(responses) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = responses[r.id]
        assert (r.refers_to, r.target_uri, r.warc_date) == (source.record_id, source.target_uri, source.warc_date)
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()  # noqa: E731, S324
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.source_payload_digest == sha(source.body.encode())
        if r.warc_type == "metadata":
            about = json.loads(r.block)
            assert about["payload_digest"] == r.source_payload_digest and about["headers"][0] == ["Content-Type", "text/html; charset=utf-8"]
            assert about["block_digest"] == sha((source.http_headers + "\r\n\r\n" + source.body).encode())
            assert len(about["links"]) == source.body.count("<a href=")
        else:
            assert "<p>" not in r.block and "track(" not in r.block and "&copy;" not in r.block


def test_two_captures_of_one_address(spark):
    rows = [(1, "http://a", "<p>one</p>"), (1, "http://a", "<p>two</p>"), (1, "http://a", None), (None, None, "<p>x</p>"), (None, "http://a", "<p>x</p>")]
    responses = warc.responses_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert len({r.record_id for r in responses.collect()}) == 5
    made = warc.derivatives(responses).collect()
    assert len({r.record_id for r in made}) == 10
    again = warc.derivatives(responses.withColumn("record_id", F.lit("")).withColumn("warc_date", F.lit(""))).collect()
    assert len({r.record_id for r in again}) >= 8


def test_conversion_text_is_the_visible_text(spark, sf):
    """All of it, by another way: tags to line feeds, inline tags to nothing."""
    import re
    from html import unescape

    for r in warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{sf}/pages.parquet").limit(150))).where("warc_type = 'conversion'").collect():
        source = {x.page_id: x.html for x in spark.read.parquet(f"{sf}/pages.parquet").where(f"page_id = {r.id}").collect()}[r.id] if r.id < 12 else None
        if source:
            t = re.sub(r"(?is)<!--.*?-->|<(script|style|title|head)\b.*?</\1>|<(textarea|svg)\b.*?</\2>", "", source)
            t = re.sub(r"(?i)</?(a|b|em|i|span|strong|u|code|label|button|input|time|small|sup|sub)\b[^>]*>", lambda m: "" if m[1].lower() != "button" else "\n", t)
            want = [" ".join(unescape(x).split()) for x in re.sub(r"<[^>]+>", "\n", t).split("\n")]
            assert "".join(r.block.split()) == "".join("".join(w.split()) for w in want if w)


def test_files_round_trip(spark, sf, tmp_path):
    records = warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{sf}/pages.parquet"))).repartition(3)
    warc.write_warc(records, f"{tmp_path}/out")
    back = {r.fields["WARC-Record-ID"]: (r.fields["WARC-Refers-To"], r.fields["WARC-Block-Digest"], bytes(r.block).decode()) for r in warc.read_warc(spark, f"{tmp_path}/out").collect()}
    assert back == {r.record_id: (r.refers_to, r.block_digest, r.block) for r in records.collect()}


def test_edges(spark):
    rows = [(1, None, None, None, None, None), (2, "<urn:uuid:x>", "http://a", "", "HTTP/1.1 200 OK\nA: b\nA: c:d\n: x\n\n", "<title>t &amp;\n u</title>x\r\n\r\nWARC/1.1\r\ny"), (2, "", "", "", "", "")]
    df = spark.createDataFrame(rows, "id long, record_id string, target_uri string, warc_date string, http_headers string, body string").selectExpr("*", "1 AS block")
    got = warc.derivatives(df).collect()
    assert len(got) == 6
    about = json.loads(next(r.block for r in got if r.warc_type == "metadata" and r.refers_to == "<urn:uuid:x>"))
    assert about["headers"] == [["A", "b"], ["A", "c:d"]] and about["title"] == "t & u" and about["status"] == "HTTP/1.1 200 OK"
    assert warc.derivatives(df.limit(0)).count() == 0
