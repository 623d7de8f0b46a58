"""Streams at size: tasks of a micro-batch follow its rows, and no file of a stream's input is made, or read, by one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from logwarden import queries as Q
from logwarden.sources import readers as R
from logwarden.streaming import ingest

from .conftest import TESTDATA


def test_tasks_of_a_batch_follow_its_rows(spark, monkeypatch):
    """Equal rows are numbered in one partition, and partitions hold no more rows than a task should take, but for what a hash gives."""
    monkeypatch.setattr(ingest, "TASK_ROWS", 100)
    batch = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 500).alias("raw"), F.lit("s").alias("source_batch"))
    n = ingest.tasks(batch)
    rows = ingest.numbered(batch, n)
    assert n == 10 and rows.rdd.getNumPartitions() == 10
    assert max(len(p) for p in rows.rdd.glom().collect()) <= 200
    assert sorted((r.raw, r.copy_) for r in rows.collect()) == sorted((r.raw, r.copy_) for r in ingest.numbered(batch).collect()) == sorted((f"r{i}", k) for i in range(500) for k in (1, 2))
    assert ingest.tasks(batch.limit(5)) == 1 == ingest.tasks(batch.where("false"))


def test_stream_state_reads_many_files(spark, monkeypatch):
    """Each of the three micro-batches is several files, and the result has all that fires."""
    monkeypatch.setattr(R, "TASK_ROWS", 40)
    folder = []
    exists = Q.exists
    monkeypatch.setattr(Q, "exists", lambda s, p: folder.append(p) or exists(s, p))
    sf = f"{TESTDATA}/sf0.001/"
    got = Q.corr_stream_state(spark, sf).select("correlation", "event_id", "rule_title", "key")
    top = next(p for p in folder if "/state-" in p).removesuffix("/done")
    files = len(spark.read.parquet(f"{top}/in").inputFiles())
    assert files >= 6 and files % 3 == 0
    every = Q.corr_many(spark, sf).where("correlation in ('Many 1', 'Many 8')").select("correlation", "event_id", "rule_title", "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.distinct().collect()))
