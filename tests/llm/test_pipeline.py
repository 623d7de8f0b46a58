from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import mixing, packing, secrets, toxicity

from .helpers import edge_docs
from .test_neardup import brute as groups
from .test_packing import check as check_packing


def test_every_stage_works_on_what_the_last_kept(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf)
        if name == "packing":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert check_packing(rows, out.collect()) < 0.02
            break
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        got = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            machine = toxicity.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = {r.doc_id: r.predicted for r in toxicity.score_documents(before, machine).collect()}
            assert set(got) == {k for k, v in scores.items() if not v} and len(got) > 0.8 * len(scores)
        elif name == "near_dedup":
            assert sorted(got) == [i for i, _, c, _ in groups(list(seen[-1].items())) if i == c]
        elif name == "secrets":
            assert set(got) == set(seen[-1]) and not any(secrets.base_spans(t.replace("[SECRET]", " ")) for t in got.values())
        else:
            want = {r.doc_id: r.copies for r in mixing.mix(before, part_of_last=False).collect()}
            assert Counter(r.doc_id for r in rows) == {k: v for k, v in want.items() if v}
        seen.append(got)


def test_run_matches_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by_seq = defaultdict(int)
    for r in rows:
        by_seq[r.sequence_id] += r.length
    assert rows and max(by_seq.values()) <= packing.WINDOW


def test_texts_of_a_repeated_id_are_kept_apart(spark):
    rows = [(5, "a b c d e f g"), (5, "t u v w x y z"), (5, "t u v w x y z"), (7, "T u v w x y z"), (3, "a b c d e F g"), (5, "k l m n o p q"), (9, ""), (9, " "), (9, None), (None, "a b c d e f g")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    want = [(3, "a b c d e F g"), (5, "t u v w x y z"), (5, "k l m n o p q"), (9, ""), (9, " "), (9, None), (None, "a b c d e f g")]
    assert Counter(tuple(r) for r in got) == Counter(want)


@pytest.mark.parametrize("stage", range(5))
def test_edges(spark, stage):
    docs = edge_docs(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert stage == 4 or out.columns == docs.columns
    assert out.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, stage):
    from .helpers import no_docs

    docs = no_docs(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "/root/testdata/sf0.001")
    assert out.collect() == [] and (stage == 4 or out.columns == docs.columns)


def test_nulls_ties_and_clashes(spark):
    """What each stage states of null texts, repeated rows and helper names."""
    rows = [(1, None, "en", None, 0, "k"), (1, None, "en", None, 0, "k"), (2, "a b c d e f", "en", "s", 11, "x"), (2, "a b c d e f", "en", "s", 11, "x"), (None, "a b c d e f", "en", "s", 11, "y"), (3, "token = abcdef99", "en", "s", 16, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_ string").withColumn("a.b", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    shown = lambda df: Counter((r[0], r[1]) for r in df.collect())
    assert shown(stages["toxicity"](spark, docs, sf)) == shown(docs)
    assert shown(stages["near_dedup"](spark, docs, sf)) == Counter([(1, None), (1, None), (2, "a b c d e f"), (None, "a b c d e f"), (3, "token = abcdef99")])
    clean = stages["secrets"](spark, docs, sf)
    assert shown(clean) == Counter([(1, None), (1, None), (2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "[SECRET]")]) and clean.where("doc_id = 3").first().n_chars == 8
    mixed = shown(stages["mixing"](spark, docs, sf))
    assert all(k[1] is not None for k in mixed) and mixed == shown(stages["mixing"](spark, docs.orderBy("row_", ascending=False), sf))
    assert stages["packing"](spark, docs, sf).where("doc_tokens = 1").count() == 2
    assert all(f(spark, docs, sf).columns == docs.columns for n, f in corpus_pipeline.STAGES[:-1])
