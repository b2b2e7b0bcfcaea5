"""WARC round trips, and captures against the pages they come from."""

import base64
import gzip
import hashlib
from collections import Counter

import pytest

from barloom.llm import warc
from barloom.llm.queries import op2_warc
from barloom.llm.warc import captures, read_archives, resolve_revisits, write_archives

PAGES = "page_id long, url string, html string, type string, record_id string"
ROWS = [
    (5, "http://a/", "<p>é</p>", "x", "y"),
    (3, "http://b/", "<p>é</p>", "x", "y"),
    (9, "http://c/\r\nWARC-Type: evil", "", "x", "y"),
    (4, None, None, "x", "y"),
    (7, "http://d/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 3, "x", "y"),
    (8, "http://e/", "z" * 300_000 + "\r\n\r\n", "x", "y"),
    (None, "http://f/", "<p>é</p>", "x", "y"),
    (None, "http://g/", "alone", "x", "y"),
    (11, "http://h/", "twice", "x", "y"),
    (11, "http://h/", "twice", "x", "y"),
    (12, "http://i/", "twice", "x", "y"),
]


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/w"
    write_archives(spark.createDataFrame(ROWS, PAGES).repartition(3), path)
    records = read_archives(spark, path)
    rows = records.collect()
    assert len(rows) == 3 * len(ROWS)
    payloads = {bytes(r["payload"]).decode() for r in rows if r["type"] == "response"}
    assert payloads == {html or "" for _, _, html, *_ in ROWS}
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() for r in rows if r["type"] == "response")
    got = resolve_revisits(captures(records)).collect()
    assert len(got) == len(ROWS)  # the page that is there twice too
    seen = {}
    for r in got:
        page = r["metadata"]["fields"]["page-id"]
        assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == r["record_id"] == r["response"]["record_id"]
        assert (r["original"] is None) == (r["response"]["type"] == "response")
        seen[page, r["response"]["target_uri"]] = (r["response"]["type"], r["original"] and r["original"]["metadata"]["fields"]["page-id"])
    assert seen["3", "http://b/"] == ("response", None) and seen["5", "http://a/"] == ("revisit", "3") and seen["", "http://f/"] == ("revisit", "3")
    assert seen["4", ""] == ("response", None) and seen["9", "http://c/%0D%0AWARC-Type: evil"] == ("revisit", "4")
    assert seen["", "http://g/"] == ("response", None) and seen["11", "http://h/"] == ("response", None) and seen["12", "http://i/"] == ("revisit", "11")


def test_query(spark, tmp_path):
    spark.createDataFrame([*ROWS, *ROWS[-2:]], PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    rows = [*ROWS, *ROWS[-2:]]
    want = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        same = [j for j, _, g, *_ in rows if (g or "").encode() == body]
        known = [j for j in same if j is not None]
        first = min(known) if known else None
        response = i == first if known else True
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first))
    assert sorted(map(str, (tuple(r) for r in op2_warc(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_many_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 7)
    write_archives(spark.createDataFrame([(None, "u", "same")] * 30 + [(2, "u", "same")] * 15 + [(1, "v", "x" * 3_000_000)], "page_id long, url string, html string"), f"{tmp_path}/w")
    records = read_archives(spark, f"{tmp_path}/w", payloads=False).collect()
    kinds = Counter(r["type"] for r in records)
    assert kinds == {"request": 46, "metadata": 46, "response": 16, "revisit": 30} and len({r["record_id"] for r in records}) == len(records)


def test_other_archives(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n\r\n\r\nWARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID: <a>\r\ncontent-type: application/http; msgtype=response\r\nContent-Length: 10\r\n\r\nX\r\n\r\nabc\r\n\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(text)
    (tmp_path / "in/b.warc.gz").write_bytes(gzip.compress(text[:60]) + gzip.compress(text[60:]))
    rows = read_archives(spark, f"{tmp_path}/in").orderBy("type").collect()
    assert [(r["type"], r["block_bytes"]) for r in rows] == [("response", 10), ("response", 10), ("warcinfo", 2), ("warcinfo", 2)]
    assert bytes(rows[0]["payload"]) == b"abc\r\n"
    only = captures(read_archives(spark, f"{tmp_path}/in")).collect()
    assert len(only) == 1 and only[0]["request"] is None and only[0]["metadata"] is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc").write_bytes(text[:-12])
    with pytest.raises(Exception, match="ends within a record"):
        read_archives(spark, f"{tmp_path}/bad").collect()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert op2_warc(spark, str(tmp_path)).collect() == []
