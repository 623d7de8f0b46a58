from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logwarden.llm import quality

from .helpers import edge_docs, edge_rows, no_docs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def check(out, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted((str(i), *brute(t)) for i, t in docs)
    rows = out.collect()
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_counts_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    check(quality.judge(docs, labels), [(r.doc_id, r.text) for r in docs.collect()])


def test_labels_are_met(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels).join(labels, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.98 * (n[0, False] + n.get((0, True), 0)) and n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))


def test_rules_learned_without_half_of_the_labels_hold_for_the_rest(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0)) and n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))


def test_native_plan(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for df in (quality.counted(docs), quality.judge(docs, labels)):
        assert not re.search("Python|Pandas|Arrow|Exchange", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("seed", range(12))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "c", "#x", "É!", "9"][: r.randint(1, 6)]
    docs = [(i, "".join(r.choice(words) + r.choice([" ", "\n", "\t\n", "  "]) for _ in range(r.randint(0, 40)))) for i in range(20)]
    check(quality.counted(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("base_failed", quality.base_failed()).withColumn("rule", F.lit(None)).withColumn("kept", ~F.col("base_failed")), docs)


def made(spark, n=3000):
    """Bad: (capitals >= 500 and marks >= 200), or chars_per_word <= 20; 1 in 50 labels of other rows is wrong."""
    r = random.Random(3)
    rows = []
    for _ in range(n):
        x = {f: r.randint(0, 1000) for f in quality.FEATURES}
        bad = (x["capitals"] >= 500 and x["marks"] >= 700) or x["chars_per_word"] <= 100
        rows.append((*x.values(), bad or r.random() < 0.02, r.random() < 0.33))
    return spark.createDataFrame(rows, ", ".join(f"{f} int" for f in quality.FEATURES) + ", bad boolean, prune boolean")


def test_conjunctions_are_found_and_noise_is_not(spark):
    rows = made(spark)
    rules = quality.learn(rows)
    assert rules == quality.learn(rows.repartition(7))
    got = rows.withColumn("hit", quality.first_rule(rules).isNotNull()).withColumn("true", F.expr("capitals >= 500 and marks >= 700 or chars_per_word <= 100"))
    n = Counter({(r["true"], r.hit): r["count"] for r in got.groupBy("true", "hit").count().collect()})
    assert n[True, True] >= 0.93 * (n[True, True] + n[True, False]) and n[False, True] <= 0.02 * n[False, False]
    assert any({c.feature for c in rule} >= {"capitals", "marks"} for rule in rules)
    text = [" and ".join(map(str, r)) for r in rules]
    assert any(t.startswith("chars_per_word <= ") for t in text)


def test_one_step_against_brute_force(spark):
    """The first condition of a list gains most, over all features, directions and cuts."""
    import math

    rows = made(spark, 300).where("not prune").collect()
    p, n = sum(r.bad for r in rows), sum(not r.bad for r in rows)
    counts = Counter((f, r[f], r.bad) for r in rows for f in quality.FEATURES)
    seen = {(f, v) for f, v, _ in counts}
    gain, c, a, b = quality._best([(f, v, counts[f, v, True], counts[f, v, False]) for f, v in seen], p, n, 5)
    best = 0.0
    for f in quality.FEATURES:
        for v in {r[f] for r in rows}:
            for side in ([r for r in rows if r[f] <= v], [r for r in rows if r[f] >= v]):
                x = sum(r.bad for r in side)
                if x >= 5 and len(side) < len(rows):
                    best = max(best, x * (math.log2(x / len(side)) - math.log2(p / (p + n))))
    side = [r for r in rows if (r[c.feature] >= c.value if c.up else r[c.feature] <= c.value)]
    assert gain == pytest.approx(best) and (sum(r.bad for r in side), sum(not r.bad for r in side)) == (a, b)


def test_edges(spark):
    labels = spark.createDataFrame([(5, 0, "x"), (6, 1, "x"), (None, 0, "y"), (8, None, "z"), (5, 1, "again")], "doc_id long, quality int, kept string")
    docs = edge_docs(spark).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        check(quality.judge(docs, some), [(r[0], r[1]) for r in edge_rows()])
        assert quality.judge(no_docs(spark), some).collect() == []


def test_very_long_texts(spark):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('lorem ipsum dolor sit amet\n', 400000), id)").alias("text"))
    out = quality.counted(docs).collect()
    assert {(r.n_words, r.n_dup_lines, r.n_repeat_words) for r in out} == {(2_000_001, 399_999, 2_000_000)}


def test_a_bound_on_rows_is_about_kept(spark):
    counts = spark.range(4000).selectExpr("id doc_id", *[f"int(id % 7) {f}" for f in quality.FEATURES], "100L n_words", "0L n_repeat_words")
    labels = spark.range(4000).selectExpr("id doc_id", "int(id % 2) quality")
    assert 800 < quality.labelled(counts, labels, rows=1000).count() < 1200 and quality.labelled(counts, labels).count() == 4000
