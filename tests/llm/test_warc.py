import gzip
import hashlib
import tempfile

from deckloom.llm.warc import derivatives, read_warc, responses, write_warc

PAGES = [
    (1, "http://a/", "<p>One &amp; two</p><script>x</script><a href=1>l</a>", "x"), (2, None, None, "x"), (3, "http://b/", "", None),
    (4, "http://c/", "text\r\n\r\nmore é 😀 " * 5000, "x"), (4, "http://c/", "text\r\n\r\nmore é 😀 " * 5000, "x"), (None, "http://d/", "<b>" * 20000, "x"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, block string")


def test_derivatives(spark):
    source = {r.record_id: r for r in responses(pages(spark)).collect()}
    got = derivatives(responses(pages(spark))).collect()
    assert len(got) == 2 * len(PAGES) and {r.record_type for r in got} == {"metadata", "conversion"}
    for r in got:
        s = source[r.refers_to]
        assert (r.target_uri, r.record_date, r.payload_digest) == (s.target_uri, s.record_date, s.payload_digest)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.source_headers == s.block.split("\r\n\r\n")[0]
        if r.record_type == "metadata":
            assert s.block_digest in r.block and all(f"source-http: {h}" in r.block for h in r.source_headers.split("\r\n"))
    texts = {r.target_uri: r.block for r in got if r.record_type == "conversion"}
    assert texts["http://a/"] == "One & two l" and texts[""] == "" and texts["http://d/"] == ""
    assert len({r.record_id for r in got}) == len(got) - 2  # the repeated page


def test_other_records_give_none(spark):
    made = responses(pages(spark))
    assert derivatives(derivatives(made).drop("source_headers")).collect() == []
    assert derivatives(made.limit(0)).collect() == []
    bare = made.selectExpr("record_type", "record_id", "refers_to", "target_uri", "record_date", "content_type", "null as block_digest", "null as payload_digest", "'HTTP/1.1 204 No Content' as block")
    assert {r.block for r in derivatives(bare).where("record_type = 'conversion'").collect()} == {""}


def test_all_character_references(spark):
    page = "<p>&Eacute;&eacute; &#233; &#x1F600; &hellip; &amp;lt; &nosuch; & &lt;b&gt;&nbsp;x</p>"
    got = derivatives(responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).where("record_type = 'conversion'").collect()
    assert [r.block for r in got] == ["Éé é 😀 … &lt; &nosuch; & <b>\u00a0x"]


def test_identifiers_tell_all_apart(spark):
    rows = [("a|b", "c", "x"), ("a", "b|c", "x"), ("a", "b|c", "y"), (None, "a", "x"), ("", "a", "x")]
    ids = [r.record_id for r in responses(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()]
    assert len(set(ids)) == 4


def test_values_cannot_break_a_file(spark):
    inner = "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/\r\nWARC-Type: evil\r\nX: y", inner), (2, "http://b/", inner * 2)]
    made = responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/out"
    write_warc(made, path, file_records=1)
    got = {r.record_id: r for r in read_warc(spark, path).collect()}
    for r in made.collect():
        assert got[r.record_id].block == r.block and got[r.record_id].record_type == "response" and got[r.record_id].block_digest == r.block_digest
    assert {r.target_uri for r in got.values()} == {"http://a/%0D%0AWARC-Type: evil%0D%0AX: y", "http://b/"}


def test_files_of_others(spark):
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    record = lambda body: b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    with open(f"{where}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(record(b"\xff\x00 bytes")) + gzip.compress(record(b"")))  # a member for each record
    with open(f"{where}/b.warc", "wb") as f:
        f.write(record(b"whole") + record(b"cut off")[:-12])
    got = sorted((r.block, r.block_digest) for r in read_warc(spark, where).collect())
    assert got == sorted((b.decode("utf-8", "replace"), "sha256:" + hashlib.sha256(b).hexdigest()) for b in (b"\xff\x00 bytes", b"", b"whole"))


def test_files_round_trip(spark):
    for how in ("gzip", "none"):
        path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/out"
        made = responses(pages(spark))
        both = made.unionByName(derivatives(made).drop("source_headers"))
        write_warc(both, path, how)
        want = sorted((r.record_type, r.record_id, r.refers_to, r.target_uri or None, r.block_digest, r.block) for r in both.collect())
        got = sorted((r.record_type, r.record_id, r.refers_to, r.target_uri, r.block_digest, r.block) for r in read_warc(spark, path).collect())
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
