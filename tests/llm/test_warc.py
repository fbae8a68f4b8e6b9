"""WARC round trips and transaction assembly."""

import gzip
import hashlib
import os

import pytest

from tagflow.llm import warc

PAGES = "page_id long, url string, html string, payload_bytes int"


def pages(spark):
    same, tricky = "x" * 150, "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\x00 <p>é</p>" * 5
    big = "".join(chr(97 + i % 26) for i in range(1000)) * 17_500        # over 16 MiB
    rows = [(5, "http://a/", same), (2, "http://b/ c\r\nX: y", same), (9, None, same), (3, "http://d/", None),
            (4, "http://e/", ""), (6, "http://f/", "short"), (7, "http://f/", "short"), (-8, "http://g/", tricky),
            (2 ** 62 + 5, "http://h/é", tricky), (11, "http://i/", big), (12, "http://j/", big)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], PAGES).repartition(4)


def expected(rows):
    first, out = {}, {}
    for i, _, h in sorted(rows):
        data = (h or "").encode()
        ref = first.setdefault(data, i) if len(data) >= 100 else i
        out[i] = (len(data), hashlib.sha256(data).hexdigest(), "response" if ref == i else "revisit", None if ref == i else ref)
    return out


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_warc(df, path, max_records=5)
    got = warc.read_captures(spark, path)
    want = expected(rows)
    seen = got.select(warc.page_of(got.record_id).alias("p"), "response.*", "requests", "metadata",
                      warc.page_of(got.response.refers_to).alias("ref")).collect()
    assert {r.p: (r.payload_bytes, r.payload_digest, r.warc_type, r.ref) for r in seen} == want
    assert len(seen) == len(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    urls = {i: u for i, u, _ in rows}
    for r in seen:
        assert r.intact and len(r.requests) == 1 and len(r.metadata) == 1
        assert f"page-id: {r.p}" in r.metadata[0].headers
        assert (r.target_uri is None) == (urls[r.p] is None)
        if r.warc_type == "response":
            assert bytes(r.payload) == texts[r.p]


def test_archives_are_plain_gzip(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_warc(df.where("page_id < 11"), path)
    n = 0
    for name in os.listdir(path):
        if name.startswith("part-"):
            raw = gzip.decompress(open(f"{path}/{name}", "rb").read())
            n += sum(1 for _ in warc.records(raw))
    assert n == 3 * 8


def test_empty_table_and_missing_id(spark, tmp_path):
    _, df = pages(spark)
    warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert warc.read_captures(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="without page_id"):
        warc.write_warc(spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "bad"))


def test_pages_without_an_id(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a/", "x" * 150), (None, "http://a/", "x" * 150), (None, None, None), (2, "http://b/", "x" * 150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_warc(df, path, without_id=True)
    got = warc.read_captures(spark, path)
    assert {len(r.requests) for r in got.collect()} == {len(r.metadata) for r in got.collect()} == {1}
    from tagflow.llm import queries
    monkeypatch.setattr(queries, "table", lambda *_: df)
    seen = queries.op4_warc(spark, "").collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in seen), key=key) == [
        (None, 0, "response", None), (None, 150, "response", None), (1, 150, "response", None), (2, 150, "revisit", 1)]


def test_query_assembles_transactions(spark):
    """The join of the side records is part of the query's plan and gives each page its request and metadata."""
    from tagflow.llm import queries
    got = queries.op4_warc(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and plan.count("MapInArrow") == 2
    assert {(r.n_requests, r.n_metadata) for r in got.collect()} == {(1, 1)}


def test_captures_without_or_with_several_side_records(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m2", "metadata", "r1"), ("m1", "metadata", "r1"),
            ("r2", "response", None), ("q9", "request", "gone"), ("w", "warcinfo", None), ("q0", "request", None)]
    full = [(i, k, c, None, None, None, None, None, None, None, True) for i, k, c in rows]
    got = {r.record_id: r for r in warc.transactions(spark.createDataFrame(full, warc.RECORD)).collect()}
    assert set(got) == {"r1", "r2"}
    assert [m.record_id for m in got["r1"].metadata] == ["m1", "m2"] and len(got["r1"].requests) == 1
    assert got["r2"].requests == [] and got["r2"].metadata == []
