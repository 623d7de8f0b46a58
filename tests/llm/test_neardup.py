from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logwarden.llm import common, neardup
from logwarden.llm.common import components

from .helpers import edge_docs, no_docs


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by_shingle.values() for n, a in enumerate(ks) for b in ks[n + 1 :]}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def run(docs):
    return sorted(tuple(r) for r in neardup.near_duplicates(docs).collect())


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_stars_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"x{i}_{r.random()}"
        rows.append((1000 - i, " ".join(w)))
    w = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((i, " ".join(w)))
        w[i * 7] = f"d{i}"
    rows += [(2000 + i, " ".join(f"s{i}_{j}" for j in range(30)) + " shared passage of a few words that many have") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, got = brute(rows), run(docs)
    same = sum(a == b for a, b in zip(want, got, strict=True))
    assert same / len(want) >= 0.98, (same, len(want))


def test_edges(spark):
    got = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == edge_docs(spark).count()
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).collect() if r.doc_id is not None]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(rows)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert run(no_docs(spark)) == []
    twice = spark.createDataFrame([(5, "a b c d e f g"), (5, "t u v w x y z"), (7, "T u v w x y z"), (3, "a b c d e F g")], "doc_id long, text string")
    assert {(r[0], r[2]) for r in run(twice)} == {(5, 3), (7, 3), (3, 3)}


def test_recall_of_links(spark):
    """Candidates by the forest against all pairs, at the least similarity that counts."""
    r = random.Random(11)
    rows, pairs = [], 0
    for g in range(150):
        w = [f"g{g}_{i}" for i in range(84)]
        v = list(w)
        for k in (20, 60):
            v[k] = f"y{g}_{k}"
        s, t = sets_of(" ".join(w)), sets_of(" ".join(v))
        pairs += 100 * len(s & t) >= 75 * len(s | t)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    r.shuffle(rows)
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs == 150 and sum(not x[3] for x in got) >= 0.98 * pairs


def crowd():
    """Thousands of pages that share boilerplate and are less than 0.75 alike, and some pairs that are 0.75 to 0.80 alike."""
    r = random.Random(13)
    shared = [f"b{i}" for i in range(90)]
    rows = [(10_000 + i, " ".join(shared + [f"u{i}_{j}" for j in range(25)])) for i in range(4000)]
    pairs = []
    for g in range(200):
        w = shared + [f"g{g}_{j}" for j in range(25)]
        n = r.randint(13, 15)
        v = w[:-n] + [f"y{g}_{j}" for j in range(n)]
        s, t = sets_of(" ".join(w)), sets_of(" ".join(v))
        assert 0.75 <= len(s & t) / len(s | t) <= 0.80
        pairs.append((2 * g, 2 * g + 1))
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
    r.shuffle(rows)
    return rows, pairs


def test_pairs_in_a_crowd(spark, monkeypatch):
    rows, pairs = crowd()
    sets = [sets_of(t) for i, t in sorted(rows) if i < 400 and i % 2 == 0 or i >= 13_900]
    assert max(len(s & t) / len(s | t) for n, s in enumerate(sets) for t in sets[:n]) < 0.75
    monkeypatch.setattr(neardup, "BLOCK", 256)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 256 * 200)
    got = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {(x[2], x[0]) for x in got if not x[3]} == set(pairs)


def test_exact_links_are_all_links(spark, monkeypatch):
    """Without chance: pairs at exactly 0.75 and just below, chains, crowds and short sets."""
    rows, _ = crowd()
    rows = [x for x in rows if x[0] < 120 or x[0] >= 13_700]
    rows += [(20_000 + i, " ".join(f"v{j}" for j in range(12 - i))) for i in range(10)] + [(21_000, "one two"), (21_001, "One two"), (21_002, "")]
    r = random.Random(3)
    w = [f"k{j}" for j in range(60)]
    for i in range(60):
        w = list(w)
        w[r.randrange(60)] = f"z{i}"
        rows.append((30_000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in neardup.near_duplicates(docs, exact=True).collect()) == brute(rows)


def test_a_text_repeated_under_one_id(spark):
    """All rows of one doc_id and text are one class, sent once by a task."""
    text = " ".join(f"h{j}" for j in range(40))
    rows = [(5, text)] * 300 + [(6, text.replace("h20", "x")), (7, " ".join(f"o{j}" for j in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert {(r[0], r[2]) for r in run(docs)} == {(5, 5), (6, 5), (7, 7)} and len(run(docs)) == 302


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 6000 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}


def connected(spark, docs, links):
    out = {}
    if not links.isEmpty():
        out = {r.node: r.component for r in components(links).distinct().collect()}
    return {r.doc_id: out.get(r.doc_id, r.doc_id) for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("region", [2, 64])
def test_links_of_crowds_without_the_forest(spark, monkeypatch, region):
    """Rare and common first shingles find all links by themselves: pages that are nearly all boilerplate, pages that are half of it, and pairs."""
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 16 * 100)
    r = random.Random(region)
    boiler = [[f"b{k}_{i}" for i in range(100)] for k in range(2)]
    rows = []
    for i in range(260):
        w = boiler[i % 2][: r.choice([100, 100, 80, 60, 45])] + [f"u{i}_{j}" for j in range(r.choice([0, 3, 10, 25, 60]))]
        rows.append((2 * i, " ".join(w)))
        if i % 4 == 0:
            n = r.randint(1, max(1, len(w) // 7))
            rows.append((2 * i + 1, " ".join(w[:-n] + [f"y{i}_{j}" for j in range(n)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    signed = neardup._signed(docs)
    classes = neardup.stage(signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("x")).select("k1", "k2", F.col("x.doc_id").alias("rep"), "x.sig", "x.n_shingles"), "near")
    apart = classes.select("k1", "rep", F.col("rep").alias("component"), F.col("n_shingles").alias("n"))
    sets = neardup.stage(neardup._sets(docs, apart.select(F.col("k1").alias("region"), F.array("k1").alias("members")), classes).select("k1", "shingles").dropDuplicates(["k1"]), "near")
    common = neardup._common(sets)
    assert (len(common[0]) > 0) and len(common[0]) == len(common[1])
    postings = neardup.stage(neardup._postings(sets, apart, common, 75), "near")
    links = neardup._links(docs, neardup.stage(neardup._pairs(postings, classes, 75), "near"), classes, 75).unionByName(neardup._common_links(docs, postings, classes, 75))
    own = signed.join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    got = connected(spark, docs, neardup.stage(links.unionByName(own), "near"))
    want = {x[0]: x[2] for x in brute(rows)}
    assert got == want and len(set(want.values())) > 30


def test_a_large_crowd_is_dealt_to_several_tasks(spark, monkeypatch):
    """No task sorts a crowd that is longer than it should hold; pairs that this parts are found all the same."""
    monkeypatch.setattr(neardup, "HELD", 300)
    rows, pairs = crowd()
    rows = [x for x in rows if x[0] < 100 or x[0] >= 12_500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(x[2], x[0]) for x in run(docs) if not x[3]} == {p for p in pairs if p[1] < 100}


def test_little_data_in_many_partitions_ends_in_few_files(spark, monkeypatch):
    """With many shuffle partitions, tables of known size are written by as many tasks as there are cores, not one for each partition; results are the same."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    made = []

    def noted(df, name, rows=None):
        out = stage(df, name, rows)
        made.append((rows is not None, len(out.inputFiles())))
        return out

    stage = common.stage
    monkeypatch.setattr(common, "stage", noted)
    monkeypatch.setattr(neardup, "stage", noted)
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    docs = spark.createDataFrame([(i, f"{words(i // 2)} t{i % 2}") for i in range(300)], "doc_id long, text string")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = neardup.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 300
    few = [n for known, n in made if known]
    assert len(few) >= 6 and max(few) <= spark.sparkContext.defaultParallelism
    assert common.file_tasks(spark, 50 * common.FILE_ROWS + 1) == 51
