from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from logwarden.llm import toxicity

from .helpers import edge_docs, no_docs


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    rows = toxicity.score_documents(docs, machine).collect()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert sum(p == t for p, t in test) / len(test) >= 0.965
    flagged = [t for p, t in test if p]
    assert sum(flagged) / len(flagged) >= 0.97 and sum(flagged) >= 0.75 * sum(t for _, t in test)
    assert toxicity.train(docs.repartition(3), labels).weights == machine.weights


def test_pairs_of_harmless_terms_are_learned():
    """Neither a nor b says anything alone; together they do."""
    r = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        noise = r.integers(100, 4000, 8)
        rows.append(np.unique(np.concatenate([noise, [1] if a else [], [2] if b else []]).astype(int)))
        labels.append(int(a == b))
    m = toxicity.fit(rows, np.array(labels), lasso=1e-5, rounds=100)
    scores = [m.score(set(x)) for x in ({1, 2}, {1}, {2}, set())]
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5 < scores[3]


def xor_rows(n, seed):
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        noise = r.integers(100, 4000, 8)
        rows.append(np.unique(np.concatenate([noise, [1] if a else [], [2] if b else []]).astype(int)))
        labels.append(int(a == b))
    return rows, np.array(labels)


@pytest.mark.parametrize("n", [1500, 8000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pairs_are_learned_at_the_default_settings(n, seed):
    m = toxicity.fit(*xor_rows(n, seed))
    scores = [m.score(set(x)) for x in ({1, 2}, {1}, {2}, set())]
    assert scores[0] > 0.7 and scores[3] > 0.7 and max(scores[1:3]) < 0.2


def test_a_rare_pair_is_learned_at_the_default_settings():
    """Two terms of 60 or so rows each in 8,000, toxic in the 14 that have both, besides a toxic word."""
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(8000):
        a, b, c = i % 133 == 0 or i < 14, i % 133 == 1 or i < 14, r.random() < 0.08
        rows.append(np.unique(np.concatenate([r.integers(100, 4000, 30), [1] if a else [], [2] if b else [], [3] if c else []]).astype(int)))
        labels.append(int((a and b) or c))
    m = toxicity.fit(rows, np.array(labels))
    assert m.score({1, 2}) > 0.3 > max(m.score({1}), m.score({2}), m.score(set())) and m.score({3}) > 0.8


def test_scores_are_explicit_sums_over_pairs(spark):
    """Every score of the machine against weights and pairs of vectors, one by one."""
    machine = toxicity.fit(*xor_rows(600, 4))
    rows = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(12)]
    bucket = lambda w: zlib.crc32(w.encode()) % toxicity.BUCKETS
    r = np.random.default_rng(0)
    terms = [bucket(f"w{j}") for j in range(0, 12, 2)]
    machine = toxicity.Machine(-1.0, {t: float(r.normal()) for t in terms}, {t: r.normal(0, 0.5, toxicity.FACTORS) for t in terms})
    got = {x.doc_id: x.score for x in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), machine).collect()}
    for i, text in rows:
        some = [bucket(w) for w in text.split() if bucket(w) in machine.weights]
        z = machine.bias + sum(machine.weights[t] for t in some)
        z += sum(float(machine.vectors[a] @ machine.vectors[b]) for k, a in enumerate(some) for b in some[:k])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_and_repeated_documents_in_training(spark, monkeypatch):
    """All terms of a long labelled text count, and a doc_id on many rows is one row of training, whatever the order."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append([(x.tolist(), int(y)) for x, y in zip(rows, labels, strict=True)]))
    long_ = " ".join(f"t{i}" for i in range(9000))
    docs = spark.createDataFrame([(1, long_), (3, "b b"), (3, "a c"), (3, "a c"), (4, None)] + [(5, "x")] * 50, "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1)], "doc_id int, toxic int")
    toxicity.train(docs, labels)
    toxicity.train(docs.orderBy("text"), labels)
    kept = [i for i in (1, 3, 4, 5) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[0] == seen[1] and len(seen[0]) == len(kept)
    if 1 in kept:
        assert max(len(x) for x, _ in seen[0]) == len({zlib.crc32(f"t{i}".encode()) % toxicity.BUCKETS for i in range(9000)})


def test_edges(spark):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "y"), (None, 1, "z"), (5, None, "z"), (999, 1, "z")], "doc_id long, toxic int, score string")
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        machine = toxicity.train(edge_docs(spark), some)
        assert toxicity.score_documents(edge_docs(spark), machine).count() == edge_docs(spark).count()
        assert toxicity.drop_toxic(edge_docs(spark), machine).columns == edge_docs(spark).columns
        assert toxicity.score_documents(no_docs(spark), machine).collect() == []
