import gzip
import hashlib
import io

from helpers import collect, extra
from resalekit.llm import warc

BIG = "<p>" + "é" * 80 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"
PAGES = [(1, "http://a.example/x?q#f", "tiny"), (2, None, BIG), (3, "http://b.example", BIG), (4, "https://c\r\nd", None), (5, "u", ""),
         (6, "http://a.example/", "tiny"), (7, "http://z", BIG + "!"), (2, "http://tie", BIG), (8, "http://dup", "d" * 200),
         (8, "http://dup", "d" * 200), (None, "http://n", BIG), (9, "http://long", "y" * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip_and_revisits(spark, tmp_path):
    warc.write_warc(extra(pages(spark, PAGES).repartition(3)), str(tmp_path / "w"), file_bytes=2000)
    got = collect(warc.captures(spark, str(tmp_path / "w")), "page_id")
    assert len(got) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    for r in got:
        htmls = [h or "" for i, _, h in PAGES if i == r["page_id"]]
        assert r["payload_digest"] in {hashlib.sha256(h.encode()).hexdigest() for h in htmls}
        assert r["payload_bytes"] in {len(h.encode()) for h in htmls}
        want = first.get(htmls[0], r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == r["page_id"] else ("revisit", want))


def test_nested_captures_hold_the_payloads(spark, tmp_path):
    rows = [p for p in PAGES if p[0] not in (2, 8, None)]
    warc.write_warc(pages(spark, rows), str(tmp_path / "w"))
    got = {int(r.metadata.fields["page-id"]): r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert set(got) == {r[0] for r in rows}
    assert bytes(got[9].response.payload) == b"y" * 300_000 and bytes(got[3].response.payload) == BIG.encode()
    assert got[1].target_uri == "http://a.example/x?q#f" and got[4].target_uri == "https://c%0D%0Ad"
    assert got[1].request.fields["host"] == "a.example" and got[1].response.fields["content-type"].startswith("text/html")


def test_files_are_gzip_streams_of_whole_records(spark, tmp_path):
    warc.write_warc(pages(spark, PAGES).coalesce(1), str(tmp_path / "w"))
    kinds = []
    for f in sorted((tmp_path / "w").glob("part-*.gz")):
        kinds += [h["warc-type"] for h, _ in warc.parse_warc(io.BufferedReader(gzip.open(f)))]
    assert len(kinds) == 3 * len(PAGES) and kinds.count("request") == kinds.count("metadata") == len(PAGES)


def test_records_without_a_capture_are_kept(spark):
    rows = [("request", "r1", "c1"), ("request", "r0", "c1"), ("metadata", "m1", "c1"), ("metadata", "m2", None), ("response", "c2", None)]
    df = spark.createDataFrame([(k, i, c, None, None, None, None, None, None, {}, None) for k, i, c in rows], warc.RECORD)
    got = {r.capture_id: r for r in warc.assemble(df).collect()}
    assert set(got) == {"c1", "m2", "c2"} and got["c1"].response is None and got["c1"].request.record_id == "r0"
    assert got["c2"].request is None and got["m2"].metadata.record_id == "m2"


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, []), str(tmp_path / "w"))
    assert warc.captures(spark, str(tmp_path / "w")).count() == 0
