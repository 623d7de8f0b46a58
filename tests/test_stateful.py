"""The stream with native state against the ledger mode, and its counters by themselves."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from logwarden.operators import correlation as C
from logwarden.operators import joint
from logwarden.streaming import stateful

from .test_correlation import CASES, T0, corr, table
from .test_joint import ledger_rows, many


@pytest.mark.parametrize("number", range(len(CASES)))
def test_counters(number):
    """The counters of one key against windows looked at one by one."""
    c, met = CASES[number]
    r = random.Random(number)
    hits = sorted((r.randint(0, 60) * 1_000_000, f"e{i:02}", r.choice(c.titles), r.choice([None, "p", "q", "s"])) for i in range(60))
    fresh = {(h[1], h[2]) for h in hits if r.random() < 0.4}
    want = set()
    for h in hits:
        inside = [x for x in hits if h[0] - c.timespan * 1_000_000 <= x[0] <= h[0]]
        if not any((x[1], x[2]) in fresh for x in inside):
            continue
        fires = met(len(inside)) if c.kind == "event_count" else met(len({x[3] for x in inside} - {None})) if c.kind == "value_count" else len({x[2] for x in inside}) >= len(set(c.titles))
        if c.kind == "temporal_ordered":
            it = iter([x[2] for x in inside if x[:3] <= h[:3]])
            fires = fires and all(any(x == s for x in it) for s in c.titles)
        if fires:
            want.add(h[:3])
    assert {x[:3] for x in stateful.anchors(hits, c, fresh)} == want


def test_stream_equals_ledger_and_restarts(spark, tmp_path):
    """Files in a shuffled order, one a micro-batch; the query is stopped after some of them and started again from its checkpoint."""
    r = random.Random(4)
    rows = ledger_rows(r, 90)
    correlations = [c for c in many(r, 40) if set(c.condition) <= {"gte", "gt", "field"}][:6] + [corr("event_count", ["A", "B"], 20, {"gte": 2}, id="z", title="Z")]
    want = {(correlations[x.rule].title, x.event_id, x.rule_title) for x in joint.evaluate_all(table(spark, rows), correlations).collect()}
    r.shuffle(rows)
    folder, schema = str(tmp_path / "in"), spark.createDataFrame([], C.LEDGER).schema
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        for run in range(2):
            for i in range(2):
                table(spark, rows[(2 * run + i) * 23 : (2 * run + i + 1) * 23]).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
            fired = stateful.correlate_stream(stream, correlations).select("correlation", "event_id", "rule_title", "event_ts", "n", F.to_json("keys").alias("keys"))
            q = fired.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(x.correlation, x.event_id, x.rule_title) for x in got} == want and len(want) > 10
    at = {x[0]: T0 + timedelta(seconds=x[3]) for x in rows if x[3] is not None}
    assert all(x.event_ts == at[x.event_id] for x in got)
    with pytest.raises(ValueError):
        stateful.correlate_stream(table(spark, rows), [corr("temporal", [("X", "correlation")], 5)])
