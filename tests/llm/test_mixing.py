from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logwarden.llm import mixing

from .helpers import edge_docs, no_docs


def expected_targets(sizes: list[int], weights=(5, 2, 1), cap=3.0) -> list[float]:
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.discard(i)
    return out


def test_sample_matches_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, bucket_rows=48, fan_in=4).collect()
    again = mixing.mix(docs.repartition(7), bucket_rows=48, fan_in=4).collect()
    assert sorted(rows) == sorted(again)
    source = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(size)
    for s, t in zip(names, expected_targets([size[s] for s in names]), strict=True):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1


def test_edges(spark):
    rows = mixing.mix(edge_docs(spark)).collect()
    assert len(rows) == edge_docs(spark).count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert mixing.mix(no_docs(spark)).collect() == []
    assert mixing.mixed_rows(no_docs(spark)).collect() == []


def test_mixed_rows_are_whole_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix(docs, part_of_last=False).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_rows(docs).collect())
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mixed_rows(edge_docs(spark)).columns == edge_docs(spark).columns


def test_reruns_agree_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATED", 16)
    r = random.Random(6)
    rows = [(r.choice([None, 1, 1, 2, i]), " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["a", "b", "c", None])) for i in range(300)]
    rows += [(None, "x y z", "a")] * 90 + [(7, "p q", "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (Counter(tuple(x) for x in mixing.mix(d, bucket_rows=32, fan_in=2).collect()) for d in (docs, docs.repartition(9, "text").orderBy(F.desc("text"))))
    assert a == b and sum(a.values()) == len(rows)
    a, b = (Counter(tuple(x) for x in mixing.mixed_rows(d, bucket_rows=32).collect()) for d in (docs, docs.repartition(5)))
    assert a == b
    want = Counter()
    for x in mixing.mix(docs.withColumn("h", F.xxhash64(*docs.columns)), part_of_last=False, content=F.col("h"), bucket_rows=32).collect():
        want[x.doc_id, x.source] += x.copies
    got = Counter()
    for (i, _, s), n in a.items():
        got[i, s] += n
    assert got == Counter({k: v for k, v in want.items() if v})


@given(st.lists(st.tuples(st.integers(1, 1000), st.floats(0.001, 0.999)), min_size=1, max_size=40), st.integers(0, 99))
def test_pivot_keeps_the_sum(items, seed):
    r = random.Random(seed)
    sizes, shares = [a for a, _ in items], [p for _, p in items]
    out = mixing.pivot(sizes, shares, [r.random() for _ in items])
    assert sum(0 < p < 1 for p in out) <= 1
    assert sum(a * p for a, p in zip(sizes, out, strict=True)) == pytest.approx(sum(a * p for a, p in items), rel=1e-6)


def test_pivot_is_unbiased():
    sums = defaultdict(float)
    for seed in range(3000):
        r = random.Random(seed)
        for i, p in enumerate(mixing.pivot([3, 5, 7, 2], [0.2, 0.5, 0.7, 0.9], [r.random() for _ in range(4)])):
            sums[i] += p / 3000
    assert [sums[i] for i in range(4)] == pytest.approx([0.2, 0.5, 0.7, 0.9], abs=0.03)
