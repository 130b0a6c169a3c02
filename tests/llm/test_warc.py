import gzip

from folio.llm.warc import dedup_archives, digest_of, parse, read, resolve, response_record, write_pages

PAGES = [
    (5, "http://x/5", "same"),
    (3, "http://x/3", "same"),
    (9, None, "same"),
    (1, "http://x/1", None),
    (2, "http://x/ 2\n", ""),
    (4, "http://x/4", "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record\r\n\r\n"),
    (6, "http://x/6", "é𒀀\n" * 20_000),
    (None, "http://x/n", "alone"),
    (7, "http://x/7", "twice"),
    (7, "http://x/7", "twice"),
    (2**60 + 1, "http://x/big", "p"),
    (2**60 + 3, None, "p"),
    (8, "http://x/8", "long" * 100_000),
]


def build(spark, tmp_path, rows, limit=0):
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_digest long")
    write_pages(df, f"{tmp_path}/a")
    dedup_archives(spark, f"{tmp_path}/a", f"{tmp_path}/b", limit)
    return read(spark, f"{tmp_path}/b").collect()


def test_round_trip_and_revisits(spark, tmp_path):
    got = build(spark, tmp_path, PAGES)
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got}
    twice = [r for r in got if r.page_id == 7]
    assert sorted((r.record_type, r.refers_to) for r in twice) == [("response", None), ("revisit", 7)]
    assert len({r.row for r in got}) == len(got)  # so record ids differ too
    assert by[2**60 + 1].record_type == "response" and by[2**60 + 3].refers_to == 2**60 + 1 and by[8].payload == PAGES[-1][2]
    assert by[3].record_type == "response" and by[3].payload == "same"
    assert [(by[k].record_type, by[k].refers_to, by[k].payload) for k in (5, 9)] == [("revisit", 3, None)] * 2
    assert by[1].record_type == "response" and by[2].refers_to == 1 and by[2].payload_bytes == 0
    assert by[4].payload == PAGES[5][2] and by[6].payload == PAGES[6][2]
    assert by[6].payload_bytes == len(PAGES[6][2].encode()) and by[6].payload_digest == digest_of(PAGES[6][2].encode())
    assert by[None].record_type == "response" and by[None].payload == "alone"
    assert all(r.payload_digest == digest_of((dict((p, h) for p, _, h in PAGES)[r.page_id] or "").encode()) for r in got)


def test_limit_and_empty(spark, tmp_path):
    assert all(r.record_type == "response" for r in build(spark, tmp_path / "x", PAGES[:3], limit=10))
    assert build(spark, tmp_path / "y", PAGES[:0]) == []


def test_records_are_valid_warc():
    data = (response_record(1, 2, "http://x", "héllo", digest_of("héllo".encode()), "2020-02-02T00:00:00Z") + "\r\n").encode()
    for raw in (data * 2, gzip.compress(data * 2)):
        (head, block), (again, _) = parse(raw)
        assert head == again and head["warc-type"] == "response" and head["warc-record-id"].startswith("<urn:uuid:")
        assert block.endswith("héllo".encode()) and int(head["content-length"]) == len(block)
    assert digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_hot_digest(spark):
    h = spark.range(3000).selectExpr("id AS row", "id AS page_id", "'u' AS url", "'d' AS date", "if(id % 3 = 0, 'hot', concat('d', id)) AS payload_digest", "5L AS payload_bytes")
    got = {r.page_id: r for r in resolve(h).collect()}
    assert got[0].record_type == "response" and all(got[i].first_id == 0 for i in range(3, 3000, 3)) and got[1].first_id is None
