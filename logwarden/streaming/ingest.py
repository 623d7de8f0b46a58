"""Live ingest: micro-batches go through the same operators as files.

Each batch appends its events and hits under its own number, correlates the
keys that it touched, and merges its alerts. A batch that fails is run again
from the checkpoint; what it had written is overwritten, and each version of
the alerts notes the last batch that it took in, so nothing counts twice
wherever the first run ended. Tables are those of store.py.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import correlation as C
from ..operators import events as E
from ..operators import joint
from ..operators import matching as M
from ..plans.catalog import Correlation
from ..plans.sigma import Rule
from ..sources.readers import TASK_ROWS
from ..sources.sinks import append_once, remove
from .store import FAN, AlertTable, BatchTable

ALERTS = (
    "dedup_key string, engine string, source_batch string, host string, rule_id string, rule_title string, rule_level string, event_count bigint, "
    "entities struct<users:array<string>,hosts:array<string>,src_ips:array<string>,dst_ips:array<string>,processes:array<string>>, sample_events array<string>, status string, created_at string"
)


class Pipeline:
    """Tables under one folder, and how a batch of raw events changes them."""

    def __init__(self, spark: SparkSession, path: str, rules: Callable[[], list[Rule]], correlations: Callable[[], list[Correlation]] = list, lists: Callable | None = None, anchors: str = "every_hit", retention: timedelta | None = None, retain_every: float = 3600.0) -> None:
        """retention: how long events stay; every retain_every seconds, and with the first batch, a batch ends by deleting older ones."""
        self.retention, self.retain_every, self._retained = retention, retain_every, None
        self.spark, self.path = spark, path.rstrip("/")
        self.rules, self.correlations, self.lists, self.anchors = rules, correlations, lists, anchors
        self.alerts = AlertTable(spark, f"{self.path}/alerts", ALERTS)
        self._events: BatchTable | None = None
        hits = spark.createDataFrame([], f"{C.LEDGER}, micro_batch bigint").schema
        self.hit_table = BatchTable(spark, f"{self.path}/hits", hits, ("rule_title", "event_ts"))

    @property
    def event_table(self) -> BatchTable:
        if self._events is None:
            none = self.spark.createDataFrame([], "raw string, source_batch string")
            schema = M.match(E.canonical(none, key=F.lit("")), []).withColumn("micro_batch", F.lit(0).cast("bigint")).schema
            self._events = BatchTable(self.spark, f"{self.path}/events", schema, ("event_ts",))
        return self._events

    def events(self) -> DataFrame:
        """All events; none before the first batch, and after all are gone."""
        return self.event_table.read()

    def hits(self) -> DataFrame:
        return self.hit_table.read()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One batch: raw and source_batch. The number of jobs is the same for any number of correlations."""
        done = self.alerts.note().get("last_batch", -1)
        matched = M.match(E.canonical(numbered(batch, tasks(batch)), key=content_key(batch_id)), self.rules(), self.lists)
        append_once(matched, f"{self.path}/events", batch_id, ("event_ts",))
        stored = self.spark.read.parquet(f"{self.path}/events/micro_batch={batch_id}")
        correlations = [c for c in self.correlations() if c.level != "informational"]
        append_once(C.ledger(stored, C.hit_spec(correlations)), f"{self.path}/hits", batch_id, ("rule_title", "event_ts"))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        columns = [c.split(" ")[0] for c in _names(ALERTS)]
        shape = lambda df: df.withColumn("status", F.lit("new")).withColumn("created_at", now).withColumn("event_count", F.col("event_count").cast("bigint")).select(*columns)
        new = shape(A.group_matches(M.matches(stored))) if batch_id > done else self.spark.createDataFrame([], ALERTS)
        work = f"{self.path}/_work/micro_batch={batch_id}"
        if correlations:

            def keep(df: DataFrame, name: str) -> DataFrame:
                df.write.mode("overwrite").parquet(f"{work}/{name}")
                return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

            # What this batch added when it ran before is not read: it is about to be written again.
            hits = self.hits().where(F.col("micro_batch") != _synthetic(batch_id)).drop("micro_batch")
            new_hits = self.spark.read.schema(C.LEDGER).parquet(f"{self.path}/hits/micro_batch={batch_id}")
            fired, added = joint.correlate_all(hits, correlations, self.anchors, new_hits, keep=keep)
            append_once(C.append_hits(hits.select("event_id", "rule_title"), added), f"{self.path}/hits", _synthetic(batch_id), ("rule_title", "event_ts"))
            own = self.spark.read.schema(C.LEDGER).parquet(f"{self.path}/hits/micro_batch={_synthetic(batch_id)}")
            for level, anchors in fired:
                new = new.unionByName(shape(joint.alerts_of(anchors, level, hits.unionByName(own), self.events(), hits)))
        self.alerts.upsert(new, F.col("engine") != "correlation", {"last_batch": max(batch_id, done)})
        remove(self.spark, work)
        # This batch may still be run again, so its folders wait.
        self.seal(batch_id - 1, FAN)
        now = time.monotonic()
        if self.retention is not None and (self._retained is None or now - self._retained >= self.retain_every):
            self.expire((datetime.now(UTC) - self.retention).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00"), batch_id - 1)
            self._retained = now

    def start(self, stream: DataFrame, checkpoint: str, seconds: float | None = 5.0, name: str = "ingest"):
        """Runs the stream by micro-batches of so many seconds; None takes what there is and ends."""
        writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: self.process(df, i))
        return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def seal(self, upto: int | None = None, least: int = 1) -> int:
        """Puts the folders of finished batches into larger parts; the number of folders. Ingest calls it; it may be called at any time when no batch runs."""
        done = self.alerts.note().get("last_batch", -1)
        upto = done if upto is None else min(upto, done)
        return self.event_table.seal(upto, least) + self.hit_table.seal(upto, least)

    def expire(self, cutoff: str, upto: int | None = None) -> tuple[int, int]:
        """Deletes events that arrived before cutoff, and hits whose event is gone, of batches up to upto; the numbers of both. A fixed number of jobs, and one commit a table: readers are never without either. Not while a batch runs."""
        self.seal(upto)
        events = self.event_table.keep(lambda rows: E.retention_split(rows, cutoff)[0])
        live = self.events().select("event_id")
        return events, self.hit_table.keep(lambda rows: E.without_orphans(rows, live))

    def delete_batch(self, source_batch: str) -> tuple[int, int]:
        """Deletes a source batch's events, hits and alerts; the numbers of events and alerts. Not while a batch runs."""
        self.seal()
        events = self.event_table.keep(lambda rows: E.delete_batch(rows, source_batch))
        self.hit_table.keep(lambda rows: E.delete_batch(rows, source_batch))
        return events, self.alerts.keep(~F.col("source_batch").eqNullSafe(F.lit(source_batch)))


def tasks(batch: DataFrame, few: int = 5_000) -> int:
    """How many tasks number, parse, match and sort a batch's rows: as many as there are cores, with few rows or more each, and with TASK_ROWS at most. What is shuffled is texts, which compress well and become wide rows, so sizes of shuffled data don't tell."""
    rows = batch.count()
    return max(-(-rows // TASK_ROWS), min(batch.sparkSession.sparkContext.defaultParallelism, -(-rows // few)), 1)


def numbered(batch: DataFrame, parts: int | None = None) -> DataFrame:
    """batch with copy_, the number of a row among equal ones, so that ids don't depend on how a batch is split; in so many partitions, if parts is given."""
    rows = batch.withColumn("text_", F.xxhash64("raw"))
    if parts:
        # The windows below are within its partitions.
        rows = rows.repartition(parts, "text_")
    same = Window.partitionBy("text_", "source_batch", "raw").orderBy(F.lit(0))
    return rows.withColumn("copy_", F.row_number().over(same)).drop("text_")


def content_key(batch_id: int) -> Column:
    """An event's id: of its batch, source, text and number among equal ones."""
    return F.sha2(F.concat_ws("|", F.lit(str(batch_id)), F.col("source_batch"), F.col("raw"), F.col("copy_").cast("string")), 256)


def _synthetic(batch_id: int) -> int:
    """The folder number of a batch's own correlation hits."""
    return -batch_id - 1


def _names(ddl: str) -> list[str]:
    from ..operators.kb import _split

    return _split(ddl)


def stream_health(query) -> dict:
    """What a running query tells of itself."""
    last = query.lastProgress or {}
    return {"active": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows"), "error": str(query.exception()) if query.exception() else None}


def without_repeats(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events whose content came already are dropped within a delay; needs a timestamp column event_at."""
    hashed = stream.withColumn("content_", F.sha2(F.concat_ws("|", "source_batch", "raw"), 256))
    return hashed.withWatermark("event_at", delay).dropDuplicatesWithinWatermark(["content_"]).drop("content_")
