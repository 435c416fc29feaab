"""Archives: what is written is read, revisits point to the largest page_id, lookups read ranges."""

import base64
import hashlib

from blendscope.llm import warc
from blendscope.session import scratch_path
from pyspark.sql import functions as F


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def stored(spark, pages):
    folder = scratch_path(spark, "warc")
    warc.write(pages, folder)
    return pages.select(warc.url_key(F.col("url")).alias("key")), folder


def test_round_trip_and_revisits(spark, frame, monkeypatch):
    rows = [(i, f"https://h{i % 7}.x.org/p?{i % 50}", f"page {i % 90} é", 0) for i in range(600)]
    rows += [(1000, None, None, 0), (1001, "no url", "", 0), (1002, "http://u@H.org:80/a b", "z" * 300_000, 0),
             (1003, "http://a.b/\r\nc", "\r\n\r\nWARC/1.1\r\n\r\n", 0), (None, "http://n/", "page 1 é", 0), (5, "http://twin/", "page 5 é", 0)]
    pages = frame(rows, "page_id bigint, url string, html string, payload int").repartition(3)
    keys, folder = stored(spark, pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(keys, folder).collect()), key=repr)
    top = {}
    for page, _, html, _ in rows:
        if page is not None:
            top[html or ""] = max(top.get(html or "", -1), page)
    want = sorted(((p, len((h or "").encode()), sha(h), *(("response", None) if p == top[h or ""] else ("revisit", top[h or ""])))
                   for p, _, h, _ in rows), key=repr)
    assert got == want

    look = warc.Lookup(spark, folder)
    for row in pages.select(warc.url_key(F.col("url")).alias("key")).groupBy("key").count().collect():
        assert len(look.find(row["key"])) == row["count"]
    assert look.find("org,nowhere)/") == []


def test_small_blocks_are_searched(spark, frame):
    lines, warc.LINES = warc.LINES, 4
    try:
        folder = scratch_path(spark, "warc")
        writer = warc.Writer(folder, 0, "1970-01-01T00:00:00Z")
        with writer.records, writer.index:
            for i in range(50):
                writer.add(f"k{i // 9:02d}", i, None, b"x%d" % i, None)
            writer.close()
    finally:
        warc.LINES = lines
    look = object.__new__(warc.Lookup)
    look.folder, look.files = folder, warc.first_keys(spark, folder)
    assert look.files == [(0, "k00")] and len(warc.directory_of(folder, 0)) == 13
    some = frame([("k03",), ("k01",), ("k03",), ("k09",), (None,)], "key string")
    assert sorted(r.page_id for r in warc.read(some, folder).collect()) == [i for i in range(50) if i // 9 in (1, 3)]
    for k in range(6):
        assert [r["page_id"] for r in look.find(f"k{k:02d}")] == [i for i in range(50) if i // 9 == k]
    assert look.find("k03x") == [] and look.find("a") == [] and look.find("z") == []


def test_key_reverses_the_host(frame):
    urls = frame([("https://Www.Example.org:8080/A?b#c",), ("bad url",), (None,)], "url string")
    assert [r.k for r in urls.select(warc.url_key(F.col("url")).alias("k")).collect()] == ["org,example,www)/A?b#c", ")bad_url", ""]


def test_empty_table(spark, frame):
    keys, folder = stored(spark, frame([], "page_id bigint, url string, html string"))
    assert warc.read(keys, folder).count() == 0 and warc.Lookup(spark, folder).find("x") == []


def test_a_key_of_most_captures_spreads_over_blocks(spark, frame):
    """Also rows equal in page_id and payload: each has its record."""
    pages = frame([(i, "http://hot/", f"p{i}") for i in range(3500)] + [(7, "http://hot/", "p7"), (9, "http://cold/", "c")],
                  "page_id bigint, url string, html string").repartition(4)
    keys, folder = stored(spark, pages)
    got = sorted(r.page_id for r in warc.read(keys, folder).collect())
    assert got == sorted([*range(3500), 7, 9])
