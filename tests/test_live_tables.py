"""The tables of live ingest: changes that are folded on reading, and micro-batches that are sealed into parts."""

from __future__ import annotations

import json
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logwarden.operators import alerts as A
from logwarden.plans.sigma import Rule
from logwarden.sources import readers as R
from logwarden.sources import sinks
from logwarden.streaming.ingest import Pipeline
from logwarden.streaming.store import TOP, AlertTable, BatchTable, due

ALERTS = "dedup_key string, engine string, source_batch string, host string, rule_title string, event_count bigint, sample_events array<string>, status string"


def made(spark, r, n):
    rows = [(f"k{r.randrange(6)}", r.choice(["rules", "correlation"]), f"b{r.randrange(3)}", f"h{r.randrange(3)}", f"t{i}", r.randrange(1, 9), r.choice([None, [f"s{r.random()}"]]), "new") for i in range(n)]
    return spark.createDataFrame(rows, ALERTS)


def test_what_merges():
    p = [{"dir": str(i), "level": v} for i, v in enumerate((TOP, 2, 1, 1, 0, 0))]
    assert due(p, 3) == (p[:1] + p[1:2], p[2:], 2) and due(p, 4) == (p, [], 0) and due([], 3) == ([], [], 0)
    assert due(p[:1] * 5, 3)[1] == [] and due([{"dir": "x", "level": 0}], 2) == ([], [{"dir": "x", "level": 0}], 1)


@pytest.mark.parametrize("fan", [2, 3])
def test_folded_changes_are_upserts_one_by_one(spark, tmp_path, fan):
    """Any number of batches, in any state of merging, with status changes and deletions in between, gives what upsert gives."""
    r = random.Random(fan)
    t = AlertTable(spark, str(tmp_path / "t"), ALERTS, fan)
    want, add = spark.createDataFrame([], ALERTS), F.col("engine") != "correlation"
    shown = lambda df: sorted((tuple(str(v) for v in x) for x in df.select(*sorted(df.columns)).collect()))
    assert t.read().count() == 0 and not t.set_status("k0", "x") and t.keep(F.lit(True)) == 0
    for i in range(8):
        new = made(spark, r, r.choice([0, 1, 5]))
        t.upsert(new, add, {"last_batch": i})
        want = spark.createDataFrame(A.upsert(want, new, add).collect(), ALERTS)
        if i in (2, 5):
            known = want.where("dedup_key = 'k1'").count() > 0
            assert t.set_status("k1", f"closed{i}") is known
            want = spark.createDataFrame(want.withColumn("status", F.when(F.col("dedup_key") == "k1", f"closed{i}").otherwise(F.col("status"))).collect(), ALERTS)
        if i == 6:
            left = want.where("source_batch <> 'b1'")
            assert t.keep(F.col("source_batch") != "b1") == want.count() - left.count()
            want = spark.createDataFrame(left.collect(), ALERTS)
        assert shown(t.read()) == shown(want) and t.note() == {"last_batch": i} and len(t.parts()) <= 2 * fan + 1, i


def test_a_batch_writes_its_own_alerts_only(spark, tmp_path):
    t = AlertTable(spark, str(tmp_path / "t"), ALERTS)
    many = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("dedup_key"), *[F.lit("x").alias(c) for c in ("engine", "source_batch", "host", "rule_title")], F.lit(1).cast("bigint").alias("event_count"), F.array(F.lit("e")).alias("sample_events"), F.lit("new").alias("status"))
    t.upsert(many, True, {"last_batch": 0})
    t.upsert(many.where("dedup_key = 'k7'"), True, {"last_batch": 1})
    assert t.set_status("k9", "closed")
    assert [t.rows_of([p]).count() for p in t.parts()] == [5000, 1, 1] and t.read().count() == 5000
    assert {(x.dedup_key, x.event_count, x.status) for x in t.read().where("dedup_key in ('k7', 'k9')").collect()} == {("k7", 2, "new"), ("k9", 1, "closed")}
    plan = t.read().where("dedup_key = 'k7'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dedup_key,k7)" in plan


SCHEMA = "event_id string, at int, micro_batch bigint"


def fill(spark, path, batches):
    for b in batches:
        sinks.append_once(spark.range(10).select(F.concat(F.lit(f"{b}-"), "id").alias("event_id"), (F.col("id") + 10 * b).cast("int").alias("at")), path, b)


def table(spark, path, fan=3):
    return BatchTable(spark, path, spark.createDataFrame([], SCHEMA).schema, ("at",), fan)


def test_sealed_batches_read_as_before(spark, tmp_path):
    path = str(tmp_path / "t")
    t = table(spark, path)
    shown = lambda: sorted((x.event_id, x.at, x.micro_batch) for x in t.read().collect())
    assert shown() == [] and t.seal(5) == 0 and t.keep(lambda df: df) == 0
    for b in range(9):
        fill(spark, path, [b, -b - 1])
        before, begun = shown(), t.read()
        assert t.seal(b - 1) == (2 if b else 0)
        # What a reader planned before a seal is still there after it.
        assert shown() == before and begun.count() == len(before) == 20 * (b + 1)
    assert len(t.manifest.parts()) <= 4 and sorted(t._folders()) == [-9, -8, 7, 8]
    # A sealed batch that is run again adds nothing.
    fill(spark, path, [3])
    assert shown() == before
    assert t.seal(8, 3) == 0 and t.seal(8, 2) == 2 and shown() == before


def test_deletion_rewrites_what_it_must_in_one_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    t = table(spark, path, 100)
    for b in range(4):
        fill(spark, path, [b])
        t.seal(b)
    dirs = [p["dir"] for p in t.manifest.parts()]
    begun, versions = t.read(), len(t.manifest._pointers())
    with monkeypatch.context() as m:
        m.setattr(sinks.json, "dumps", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.keep(lambda df: df.where("at >= 15"))
    assert t.read().count() == 40
    assert t.keep(lambda df: df.where("at >= 15")) == 15 and t.keep(lambda df: df.where("at >= 15")) == 0
    now = [p["dir"] for p in t.manifest.parts()]
    assert now[1:] == dirs[2:] and "part_=0" in now[0] and begun.count() == 40 and versions >= 2
    assert sorted(x.at for x in t.read().collect()) == list(range(15, 40))
    # Parts that were written by one job are told apart, and merge, when they lose rows again.
    assert t.keep(lambda df: df.where("at % 2 = 0")) == 13 and len(t.manifest.parts()) == 3
    assert t.keep(lambda df: df.where("at < 30 and at % 4 = 0")) == 8 and sorted(x.at for x in t.read().collect()) == [16, 20, 24, 28]
    assert t.keep(lambda df: df.where("at < 0")) == 4 and t.manifest.parts() == [] and t.read().count() == 0
    fill(spark, path, [4])
    assert t.read().count() == 10 and t.seal(4) == 1 and t.read().count() == 10


def test_retention_runs_with_batches(spark, tmp_path):
    """With no time to stay, each batch deletes the events of those before it; its own wait, as it may be run again. Alerts stay."""
    rule = Rule("r", "Any", "high", detection={"s": {"EventID": 1}, "condition": "s"})
    p = Pipeline(spark, str(tmp_path / "p"), lambda: [rule], retention=timedelta(0), retain_every=0)
    for i in range(3):
        p.process(R.from_dicts(spark, [{"EventID": 1, "Hostname": "h", "n": i}], "s"), i)
        assert [json.loads(x.raw)["n"] for x in p.events().collect()] == [i] and [x.event_count for x in p.alerts.read().collect()] == [i + 1]
    late = Pipeline(spark, str(tmp_path / "p"), lambda: [rule], retention=timedelta(days=1))
    late.process(R.from_dicts(spark, [{"EventID": 1, "Hostname": "h", "n": 3}], "s"), 3)
    assert late.events().count() == 2


def test_few_partitions_are_spread(spark):
    assert R.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 9)
    assert R.spread(many).rdd.getNumPartitions() == 9


def test_a_task_has_so_many_rows_at_most(spark):
    """The number of partitions follows the rows, not only the cores."""
    cores = spark.sparkContext.defaultParallelism
    assert R.spread(spark.range(1000).coalesce(1), "id", most=50).rdd.getNumPartitions() == 20
    assert R.spread(spark.range(1000).repartition(cores + 1), "id", most=50).rdd.getNumPartitions() == 20
    assert R.spread(spark.range(1000).repartition(30), "id", most=50).rdd.getNumPartitions() == 30
