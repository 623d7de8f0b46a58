from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import importance

from .helpers import edge_docs, edge_rows, no_docs

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(lower)
    return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of all rows, in order."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(w) >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(f), weight))
    rows.sort(key=lambda r: (-r[0], -r[1], r[2] is None, r[2] or 0, r[3]))
    n = 25 * sum(r[0] for r in rows) // 100
    return [(i, k, weight, score, place if place <= n else None) for place, (_, score, i, k, weight) in enumerate(rows, 1)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def same(df, docs, target):
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(brute(docs, target), key=key)


def test_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    out = importance.resample(docs, bench)
    same(out, [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert out.where("rank is not null").count() > 20 and dict(out.dtypes) == dict.fromkeys(out.columns, "bigint")


def test_edges_ties_and_repeated_rows(spark):
    more = [(100 + i % 3, "Same words again and again " * 8) for i in range(60)] + [(100, "other text with more than twenty words " * 4)]
    docs = edge_docs(spark).select("doc_id", "text", "rank", "score", "bucket").unionByName(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'c' rank", "'c' score", "'c' bucket"))
    target = spark.createDataFrame([("alpha beta gamma", 1), (None, 2), ("Same words", 3)], "text string, n int")
    rows = [(r[0], r[1]) for r in edge_rows()] + more
    same(importance.resample(docs, target), rows, ["alpha beta gamma", None, "Same words"])
    same(importance.resample(docs, target.limit(0)), rows, [])
    assert importance.resample(no_docs(spark), target).collect() == []


def test_ranks_over_many_ranges(spark, monkeypatch):
    """A third of all rows are equal, and ranges are small."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 50)
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.expr("repeat(concat('word', id % 3, ' '), 25)").alias("text"))
    ranks = [r["rank"] for r in importance.resample(docs, docs.limit(1)).where("rank is not null").orderBy("rank").collect()]
    assert ranks == list(range(1, 226))


@pytest.mark.parametrize("piece", [1, 7, 64])
@pytest.mark.parametrize("longest", [1, 2, 3])
def test_pieces_of_long_texts(monkeypatch, piece, longest):
    text = "Ünï Abc d, e_f  gh--i 12x " * 9 + "x" * 40 + "   last"
    whole = importance.buckets_of(text.encode(), longest)
    monkeypatch.setattr(importance, "PIECE", piece)
    part = importance.buckets_of(text.encode(), longest)
    assert whole[0] == part[0] and np.array_equal(np.sort(whole[1]), np.sort(part[1])) and len(whole[1]) == sum(whole[0] - k for k in range(longest))


def test_texts_beyond_a_batch(spark):
    """A stream holds 8 MB of texts or one longer one."""
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("repeat('lorem ipsum dolor ', 600000)").alias("text"))
    out = importance.resample(docs.repartition(1), docs.limit(1)).collect()
    assert {r.n_features for r in out} == {3_599_999}
