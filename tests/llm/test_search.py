from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from logwarden.llm import search


def brute(rows, queries, k):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        w = [math.floor(256 * float(x)) for x in e]
        v[i] = min(v.get(i, w), w)
    out = []
    for q in sorted(v):
        if queries(q):
            s = sorted((-min(max(sum(a * b for a, b in zip(v[q], v[c], strict=False)), 1 - 2**63), 2**63 - 1), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def run(table, step, **options):
    v = search.integer_vectors(table)
    return sorted(tuple(r) for r in search.search(v, F.expr(f"vec_id % {step} = 0"), **options).collect())


def test_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert run(table, 10, block=32, pivots=8) == brute(rows, lambda q: q % 10 == 0, 5)
    assert run(table, 10, block=500, round_=20) == brute(rows, lambda q: q % 10 == 0, 5)


def test_edges(spark):
    r = np.random.default_rng(1).normal(0, 0.3, (40, 6)).astype("float32").tolist()
    rows = [(i, v) for i, v in enumerate(r)] + [(50, None), (None, r[0]), (51, [1.0, None] + r[0][2:]), (52, [float("nan")] * 6), (53, [float("inf")] * 6), (3, r[3]), (3, r[4]), (60, []), (61, r[2][:3])]
    rows += [(100 + i, r[7]) for i in range(30)]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, v string, pivot int")
    assert run(table, 5, block=4, pivots=5) == brute(rows, lambda q: q % 5 == 0, 5)
    assert run(table.limit(0), 5) == []
    assert run(table.where("vec_id = 5"), 5) == []


def test_large_components_are_exact(spark):
    """Finite components of any size take part: products past 2^53 are exact, and those past a long are its ends."""
    r = np.random.default_rng(2).normal(0, 0.3, (30, 4)).tolist()
    rows = [(i, v) for i, v in enumerate(r)]
    rows += [(100, [1e30, 0.0, 0.0, 0.0]), (101, [1e30, -1e30, 1.0, 0.0]), (102, [-1e30, 0.0, 0.5, 0.0]), (105, [1e300, 1e300, 1e300, 1e300]), (106, [1e308, 0.0, 0.0, 0.0])]
    rows += [(110 + i, [float(2**20 + i), 3.0 + i, float(2**19), 1.0]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [x for x in rows if x[0] != 106]
    assert run(table, 5, block=4, pivots=3) == brute(kept, lambda q: q % 5 == 0, 5)
    assert run(table.where("vec_id >= 100"), 5, round_=2) == brute([x for x in kept if x[0] >= 100], lambda q: q % 5 == 0, 5)


def test_expansion_stops_early():
    """Queries visit few annuli, and those hold the best."""
    r = np.random.default_rng(5)
    m = np.floor(r.normal(0, 80, (4000, 6)))
    points = search.choose_pivots(m[:200], 4)
    d = search._distances(m, points)
    blocks = []
    for p in range(4):
        some = np.flatnonzero(d.argmin(1) == p)
        some = some[np.argsort(d[some, p])]
        for i in range(0, len(some), 50):
            part = some[i : i + 50]
            blocks.append((p, d[part[0], p], d[part[-1], p], float((m[part] ** 2).sum(1).max()), part.astype(np.int64).tobytes(), m[part].tobytes()))
    ids = np.arange(0, 4000, 40)
    floor = search._floor(ids, m[ids], np.arange(200), m[:200], 3)
    round_ = search.Round(ids, m[ids], points, 3, floor)
    visits = []
    visit = round_.visit
    round_.visit = lambda which, *a: (visits.append(len(which)), visit(which, *a))
    round_.search(blocks)
    want = brute([(i, (v / 256).tolist()) for i, v in enumerate(m)], lambda q: q % 40 == 0, 3)
    assert [(int(q), k + 1, int(i), int(s)) for q, ss, ii in zip(ids, round_.best.scores, round_.best.ids) for k, (s, i) in enumerate(zip(ss, ii))] == want
    assert sum(visits) < 0.6 * len(ids) * len(blocks)


def test_bounds_hold():
    r = np.random.default_rng(3)
    v, q, p = r.normal(0, 50, (300, 8)), r.normal(0, 50, (20, 8)), r.normal(0, 50, 8)
    d = np.sqrt(((v - p) ** 2).sum(1))
    some = v[(d > np.quantile(d, 0.3)) & (d < np.quantile(d, 0.5))]
    ds = np.sqrt(((some - p) ** 2).sum(1))
    top = search.bounds(np.sqrt((q**2).sum(1)), np.sqrt(((q - p) ** 2).sum(1)), q @ p, ds.min(), ds.max(), (some**2).sum(1).max())
    assert (q @ some.T <= top[:, None]).all()
