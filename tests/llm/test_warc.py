from __future__ import annotations

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from logwarden.llm import warc


def brute(rows, least=0):
    last = {}
    for i, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        first = last.get(h or "") if len(p) >= least else i
        revisit = first is not None and i != first
        out.append((-1 if i is None else i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else -1))
    return sorted(out)


def shown(df):
    none = lambda x: -1 if x is None else x
    return sorted((none(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in df.collect())


ROWS = [
    (1, "http://b.example.com/x", "same"), (2, "http://a.example.com/", "same"), (3, "https://www.a.example.com:443/q?z=1#f", "é\r\n\r\nWARC/1.1\r\n"), (4, None, None), (5, "not a url\r\nX: y", ""),
    (6, "http://[bad", "x" * 200_000), (7, "http://a.example.com/", "same"), (7, "http://a.example.com/", "same"), (None, "http://n.example.com", "same"), (None, None, "alone"),
]


def test_edges(spark):
    pages = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string")
    rows = [(i, h) for i, _, h in ROWS]
    assert shown(warc.archive_pages(pages)) == brute(rows)
    assert shown(warc.archive_pages(pages, least_bytes=5)) == brute(rows, 5)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_sample_is_globally_ordered(spark, tmp_path, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(3)
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    index = warc.merge_index(warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))), rows_per_task=30)
    rows = sorted(index.collect(), key=lambda r: r.position)
    assert len({r.run for r in rows}) > 3
    order = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert order == sorted(order) and len(rows) == pages.count()
    assert shown(index) == brute([(r.page_id, r.html) for r in pages.collect()])
    one = next((tmp_path / "w").glob("*.gz"))
    data = gzip.decompress(Path(one).read_bytes())
    for head, _, at, n in warc.parse_records(data):
        assert data[at : at + 8] == b"WARC/1.1" and data[at + n - 4 : at + n] == b"\r\n\r\n" and head["warc-type"] in ("response", "revisit")


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort\r\n\r\n"))


def test_loser_tree():
    r = random.Random(4)
    for k in range(8):
        runs = [sorted((r.randint(0, 20), i, j) for j in range(r.randint(0, 9))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x[0])) == sorted((x for run in runs for x in run), key=lambda x: x[:2])


def test_surt():
    assert warc.surt("https://www.Example.com:443/A?b=1#c") == "com,example)/a?b=1"
    assert warc.surt("http://example.com:8080") == "com,example:8080)/"
