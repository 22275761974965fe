import io
import zlib

import pytest

from tallyforge.llm import warc

PAGES = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://b/ x\ny", "same"), (4, None, None), (5, "", ""), (6, "http://c/", "\r\n\r\nWARC/1.1 é\U0001f600\r\n\r\n"),
    (7, "http://long/", "long text " * 200_000), (None, "http://n/", "same"), (8, "u", "alone"), (9, "u", "twice"), (9, "u", "twice"), (None, "u", "null alone"),
]


def expected(pages, least=0):
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        n = sum((h or "").encode() == data for _, _, h in pages)
        head = max(same) if same and n > 1 and len(data) >= least else None
        revisit = head is not None and page != head
        out.append((page, len(data), warc.sha1_base32(data), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, head int").repartition(3)
    got = warc.archive_pages(pages, least)
    assert sorted(map(tuple, got.collect()), key=str) == expected(PAGES, least)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    written = warc.write_archives(warc.with_revisits(pages, 10**9), f"file://{tmp_path}", archive_bytes=1000)
    assert written.count() > 1 and written.agg({"records": "sum"}).first()[0] == len(PAGES)
    rows = warc.read_archives(written).where("warc_type = 'response'").collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in PAGES)
    assert {r.error for r in rows} == {None} and {r.target_uri for r in rows} >= {"http://b/%20x%0Ay"}


def test_headers_of_any_length(spark):
    pages = [(1, "http://a/" + "x" * 1_300_000, "body"), (2, "http://b/", "body")]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages)


def test_payloads_of_many_pages(spark):
    pages = [(i, "u", "hot" if i % 3 else f"own {i // 6}") for i in range(1500)]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def good(name="r", body=b"HTTP/1.1 200 OK\r\n\r\nbody"):
    return warc.record("response", name, body, body.partition(b"\r\n\r\n")[2])


def rows(data):
    return [warc._row("a", r, True) for r in warc.Reader(io.BytesIO(data))]


def pack(text):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def test_members_are_found_by_offset():
    found = list(warc.Reader(io.BytesIO(good("a") + good("b") * 2)))
    assert [r.offset for r in found] == [0, len(good("a")), len(good("a")) + len(good("b"))]


@pytest.mark.parametrize(
    ("damage", "error"),
    [
        (lambda t: t.replace(b"body", b"b0dy"), "the block digest differs"),
        (lambda t: t.replace(b"Content-Length: 23", b"Content-Length: 22"), "the block does not end where its content length says"),
        (lambda t: t.replace(b"Content-Length: 23", b"Content-Length: 99"), "the block is shorter than its content length"),
        (lambda t: t.replace(b"Content-Length: 23", b"Content-Length: x"), "no content length"),
        (lambda t: t.replace(b"WARC/1.1", b"HTTP/1.1"), "not a WARC record"),
        (lambda t: b"nothing", "no end of the record's header"),
        (lambda t: t.replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:AA"), "the payload digest differs"),
    ],
)
def test_damage_is_reported_and_the_next_record_read(damage, error):
    found = rows(pack(damage(zlib.decompress(good("a"), 31))) + good("b"))
    assert found[0]["error"] == error
    assert found[1]["record_id"] == "b" and found[1]["error"] is None and found[1]["payload"] == b"body"


def test_a_torn_archive_ends_in_an_error():
    data = good("a") + good("b")
    assert [r["error"] is None for r in rows(data[:-9])] == [True, False]
    assert [r["error"] is None for r in rows(good("a") + b"junk" + good("b"))] == [True, False]
