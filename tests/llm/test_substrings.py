from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import substrings

from .helpers import edge_docs, no_docs


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter()
    for _, w in words:
        seen.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def run(docs, window):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_digests(docs, window).collect())


def test_sample_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert run(docs, 35) == want and any(x[2] for x in want)
    docs = edge_docs(spark)
    assert run(docs, 35) == brute([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert substrings.repeat_digests(no_docs(spark)).collect() == []


@pytest.mark.parametrize("window", [5, 8])
def test_planted_passages_and_dense_repeats(spark, window):
    r = random.Random(window)
    rows = []
    passages = [[f"p{i}_{j}" for j in range(r.randint(window - 1, 3 * window))] for i in range(6)]
    for i in range(60):
        w = [r.choice("abcdefgh") for _ in range(r.randint(0, 30))]
        for p in r.sample(passages, 2):
            w += p[r.randint(0, 2) :] + [f"u{i}"]
        rows.append((i, " ".join(w)))
    rows.append((60, "a " * 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs, window) == brute(rows, window)


def test_a_common_passage_is_sent_once_a_chunk(spark):
    """A passage of many documents: a chunk's copies are one, and buckets get even shares of other windows."""
    passage = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"u{i} {passage} v{i}") for i in range(400)]
    r = random.Random(1)
    for i in range(60):
        own = " ".join(f"q{r.randint(0, 10**9)}" for _ in range(120))
        rows += [(1000 + 2 * i, f"{own} x{i}"), (1001 + 2 * i, f"y{i} {own}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs, 35) == brute(rows, 35)
    sent = []
    real = substrings.map_rows

    def spy(df, fn, schema, *more):
        out = real(df, fn, schema, *more)
        if "lengths" in out.columns:
            out = out.cache()
            sent.append(out.select("bucket", "kind", F.length("first").alias("n")).collect())
        return out

    substrings.map_rows = spy
    try:
        assert run(docs, 35) == brute(rows, 35)
    finally:
        substrings.map_rows = real
    windows = Counter()
    for x in sent[0]:
        if x.kind == 0:
            windows[x.bucket] += x.n // 8
    chunks = docs.rdd.getNumPartitions()
    assert sum(windows.values()) <= chunks * 62 + 2 * 60 * 90
    assert max(windows.values()) <= 4 * sum(windows.values()) / 16


def test_rolling_hash_and_squeezing():
    w = np.random.default_rng(0).integers(0, 1 << 63, 200, np.uint64)
    w[100:140] = w[20:60]
    h = substrings.rolling(w, 18)
    assert len(h) == 183 and (h[100:123] == h[20:43]).all() and len(np.unique(h)) == 183 - 23
    for n in (1, 2, 500):
        x = np.sort(np.random.default_rng(n).integers(0, 1 << 48, n, np.uint64))
        assert (substrings._expand(substrings._squeeze(x)) == x).all()


@pytest.mark.parametrize("fan, probes", [(4, 300), (16, 20)])
def test_buckets_beyond_what_a_chunk_is_dealt_to(spark, monkeypatch, fan, probes):
    """Rounds of coarse and finer buckets find what one round finds."""
    r = random.Random(fan)
    shared = [[f"s{k}_{i}" for i in range(50)] for k in range(5)]
    rows = [(i, " ".join([f"u{r.randint(0, 10**6)}" for _ in range(60)] + (r.choice(shared)[: r.randint(34, 50)] if i % 2 else []))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "FAN", fan)
    monkeypatch.setattr(substrings, "BUCKET_PROBES", probes)
    monkeypatch.setattr(substrings, "PARTITIONS", 8)
    assert run(docs, 35) == brute(rows, 35)


def test_rows_of_a_chunk_do_not_grow_with_the_buckets(spark, monkeypatch):
    """A chunk sends two rows a bucket of the first round at most, with 16 buckets as with 65,536."""
    text = F.expr("concat_ws(' ', transform(sequence(1, 4000), i -> concat('w', id, '_', i)))")
    docs = spark.range(8).select(F.col("id").alias("key"), text.alias("text")).repartition(2).cache()
    real, sent = substrings.map_rows, []

    def spy(df, fn, schema, *more):
        out = real(df, fn, schema, *more)
        if not sent and "probes" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(substrings, "map_rows", spy)
    for buckets in (16, 1 << 16):
        sent.clear()
        substrings.hit_blocks(docs, 35, buckets)
        assert sent[0] <= 2 * (2 * min(buckets, substrings.FAN) + 1), buckets


def test_texts_that_a_batch_cannot_hold(spark):
    """Texts of 10 MB: few at a time are words."""
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('lorem ipsum dolor sit amet ', 370000), id)").alias("text")).repartition(1)
    out = substrings.repeat_digests(docs).collect()
    assert {(r.n_words, r.n_removed) for r in out} == {(1_850_001, 1_850_000)}
