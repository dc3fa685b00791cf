import base64
import gzip
import hashlib

import pandas as pd

from runloom.functions.workspace import new_folder
from runloom.llm import warc
from runloom.llm.queries import QUERIES


def expected(rows):
    out = []
    for i, html in rows:
        data = (html or "").encode()
        same = [j for j, h in rows if (h or "") == (html or "") and j is not None]
        top = max(same) if same else None
        revisit = len([1 for _, h in rows if (h or "") == (html or "")]) > 1 and top is not None and i != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "<p>a</p>"), (2, None), (3, ""), (4, "<p>a</p>"), (4, "<p>a</p>"), (None, "<p>a</p>"), (6, "é\r\n\r\nWARC/1.1\r\n"),
            (7, "z" * 300_000)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", h, "clash", 5) for i, h in rows],
                                  "page_id long, url string, html string, payload string, offset int")
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(warc.plan_records(pages, "page_id", "url", "html", broadcast_payloads=0), folder, archive_bytes=200)
    got = warc.read_records(index, folder)
    found = [(r.record_id and int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type,
              r.refers_to and int(r.refers_to)) for r in got.collect()]
    assert sorted(found, key=str) == expected(rows)
    assert {r.payload.decode() for r in got.filter("record_type = 'response'").collect()} == {h or "" for _, h in rows}
    assert all(r.payload is None for r in got.filter("record_type = 'revisit'").collect())
    # Every member is a gzip file of its own, and one archive holds them end to end.
    names = index.select("archive").distinct().collect()
    for n in names:
        data = open(f"{folder}/{n.archive}", "rb").read()
        own = index.filter(index.archive == n.archive).orderBy("offset").collect()
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert gzip.decompress(data).count(b"WARC-Type: ") == len(own)


def test_small_payloads_are_not_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.plan_records(pages, "page_id", "url", "html", min_revisit_bytes=3)
    assert {(r.record_id, r.record_type, r.refers_to) for r in got.collect()} == {
        ("1", "response", None), ("2", "response", None), ("3", "revisit", "4"), ("4", "response", None)}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"), folder)
    assert warc.read_records(index, folder).count() == 0


def test_near_records_are_read_together():
    rows = [{"archive": a, "offset": o, "length": n} for a, o, n in [("x", 0, 10), ("x", 12, 5), ("x", 100, 5), ("y", 105, 5), ("y", 110, 90)]]
    runs = [[(r["archive"], r["offset"]) for r in run] for run in warc.coalesced(rows, gap=5, most=50)]
    assert runs == [[("x", 0), ("x", 12)], [("x", 100)], [("y", 105)], [("y", 110)]]


def test_query_equals_brute_force(spark, sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")
    got = QUERIES["op1_warc"](spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(list(zip(pages.page_id.tolist(), pages.html)))
