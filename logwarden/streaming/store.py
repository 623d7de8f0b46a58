"""The tables of live ingest: what a batch writes is in proportion to the batch, and what a reader lists grows with the logarithm of the batches.

Both kinds merge small parts into larger ones as they come, FAN of one level
to one of the next, so a row is written again once a level. A part is named by
one manifest, whose replacement is the only moment at which anything changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import alerts as A
from ..sources.sinks import VersionedTable, remove

#: Parts of one level that become one of the next.
FAN = 8
#: Bytes from which on a part of events or hits is not merged further.
PART_BYTES = 4 << 30
#: A level that no part grows to: parts of it are not merged.
TOP = 99


def due(parts: list[dict], fan: int, level: int = 0) -> tuple[list[dict], list[dict], int]:
    """(parts that stay, last parts that merge with a new one of this level, the level of the outcome). Merging goes on upwards while a level is full."""
    stay, take = list(parts), []
    while len(stay) >= fan - 1 and all(p.get("level", TOP) == level for p in stay[len(stay) - fan + 1 :]):
        stay, take, level = stay[: len(stay) - fan + 1], stay[len(stay) - fan + 1 :] + take, level + 1
    return stay, take, level


class AlertTable(VersionedTable):
    """Alerts as changes that are folded when they are read.

    A batch adds one part with its own alerts, or status changes, and nothing
    that is stored is written again but by merges. Rows of parts carry the
    number of the commit that added them. Empty batches add a part, too, so
    that the note and the rows change in one commit.
    """

    def __init__(self, spark: SparkSession, path: str, alerts: str, fan: int = FAN) -> None:
        super().__init__(spark, path, f"{alerts}, seq_ bigint, adds_ boolean, set_status_ string")
        self.alerts, self.fan = alerts, fan

    def read(self) -> DataFrame:
        """The alerts. A condition on dedup_key reaches the files."""
        parts = self.parts()
        found = self.rows_of(parts)
        rows = found if len(parts) == 1 else A.fold_changes(found)
        status = F.coalesce("set_status_", "status").alias("status")
        return rows.where(F.col("event_count").isNotNull()).select(*[status if c == "status" else c for c in rows.columns if not c.endswith("_")])

    def _add(self, changes: DataFrame, note: dict) -> None:
        now = self._current()
        seq = _last(now["parts"]) + 1
        stay, take, level = due(now["parts"], self.fan)
        rows = changes.withColumn("seq_", F.lit(seq).cast("bigint")).select(*self.rows_of([]).columns)
        if take:
            rows = A.fold_changes(self.rows_of(take).unionByName(rows))
        self.replace(rows, note, stay, {"level": level, "seq": seq})

    def upsert(self, new: DataFrame, add: bool | Column, note: dict) -> None:
        """New alerts by A.upsert's rules, and the note, in one commit."""
        self._add(A.one_per_key(new, add).withColumn("set_status_", F.lit(None).cast("string")), note)

    def set_status(self, dedup_key: str, status: str) -> bool:
        """Sets one alert's status; whether there is such an alert."""
        if not self.read().where(F.col("dedup_key") == dedup_key).select("dedup_key").head(1):
            return False
        none = self.spark.createDataFrame([(dedup_key, status)], "dedup_key string, set_status_ string")
        shape = self.rows_of([])
        one = none.select(*[F.col(f.name) if f.name in none.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.schema])
        self._add(one.withColumn("adds_", F.lit(True)), self.note())
        return True

    def keep(self, condition: Column) -> int:
        """Deletes alerts for which condition is not true; the number of them. All parts become one."""
        table = self.read()
        n = table.where(~F.coalesce(condition, F.lit(False))).count()
        if n:
            seq = _last(self.parts())
            left = table.where(condition).withColumn("seq_", F.lit(seq).cast("bigint")).withColumn("adds_", F.lit(True)).withColumn("set_status_", F.lit(None).cast("string"))
            self.replace(left, self.note(), (), {"level": TOP, "seq": seq})
        return n


class BatchTable:
    """Rows of micro-batches. A batch writes a folder of its own; folders of finished batches are sealed into parts.

    The manifest notes the last sealed batch. Readers take the parts, and of
    the folders only those of later batches, so folders may stay when they are
    sealed, and a batch that runs again changes nothing that is sealed.
    Numbers below zero belong to the same batches (-n - 1 to n).
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: tuple[str, ...], fan: int = FAN) -> None:
        self.spark, self.path, self.schema, self.order, self.fan = spark, path, schema, order, fan
        self.manifest = VersionedTable(spark, f"{path}/_parts", schema)

    def _folders(self) -> dict[int, str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return {int(m[1]): n for n in names if (m := re.fullmatch(r"micro_batch=(-?\d+)", n))}

    def _fresh(self, folders: list[int]) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).schema(self.schema).parquet(*[f"{self.path}/micro_batch={n}" for n in folders])
        return rows.select(*self.schema.names)

    def read(self) -> DataFrame:
        """All rows, with micro_batch. Nothing is listed but the parts and the folders since."""
        now = self.manifest._current()
        fresh = [n for n in self._folders() if _batch(n) > now["note"].get("last", -1)]
        if not fresh:
            return self.manifest.rows_of(now["parts"])
        rows = self._fresh(fresh)
        return self.manifest.rows_of(now["parts"]).unionByName(rows) if now["parts"] else rows

    def seal(self, upto: int, least: int = 1) -> int:
        """Puts the folders of batches up to upto, which must be finished, into parts, if there are as many as least; the number of folders. Rows in a part are sorted, so time ranges read little of it."""
        now = self.manifest._current()
        last, folders = now["note"].get("last", -1), self._folders()
        fresh = [n for n in folders if last < _batch(n) <= upto]
        if len(fresh) < max(1, least):
            return 0
        stay, take, level = due(now["parts"], self.fan)
        rows = self._fresh(fresh)
        if take:
            rows = self.manifest.rows_of(take).unionByName(rows)
        by = self.order[-1]
        name = self.manifest.write(rows.repartitionByRange(F.col(by)).sortWithinPartitions(*self.order))
        size = self._bytes(name)
        self.manifest.commit([*stay, {"dir": name, "level": TOP if size > PART_BYTES else level}], {"last": upto})
        # Readers that began before this commit may still read what it sealed: only what earlier ones had sealed goes.
        for n in folders:
            if _batch(n) <= last:
                remove(self.spark, f"{self.path}/{folders[n]}")
        return len(fresh)

    def _bytes(self, name: str) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.manifest.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def keep(self, kept_of: Callable[[DataFrame], DataFrame]) -> int:
        """Deletes the rows of sealed batches that kept_of, which must pass extra columns on, does not keep; the number of them.

        Counts are by part. Parts that lose nothing stay as they are, parts
        that lose all their rows are left out, and the rest are written again
        by one job; one commit ends it, so readers see all rows or the kept.
        """
        now = self.manifest._current()
        parts = now["parts"]
        if not parts:
            return 0
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/_parts/(v-.+)/[^/]*$", 1)
        rows = self.manifest.rows_of(parts).withColumn("part_", at)
        kept = kept_of(rows)
        count = lambda df: {r[0]: r[1] for r in df.groupBy("part_").agg(F.count("*")).collect()}
        before, after = count(rows), count(kept)
        less = {d for d, n in before.items() if after.get(d, 0) < n}
        if not less:
            return 0
        again = {d: i for i, d in enumerate(sorted(d for d in less if after.get(d)))}
        top = ""
        if again:
            some = kept.where(F.col("part_").isin(list(again)))
            number = F.create_map(*[F.lit(x) for pair in again.items() for x in pair])[F.col("part_")]
            top = self.manifest.write(some.withColumn("part_", number).sortWithinPartitions("part_", *self.order), "part_")
        stay = [p | {"dir": f"{top}/part_={again[p['dir']]}"} if p["dir"] in again else p for p in parts if p["dir"] not in less or p["dir"] in again]
        self.manifest.commit(stay, now["note"])
        return sum(before.values()) - sum(after.values())


def _last(parts: list[dict]) -> int:
    """The number of the commit that added the last of an alert table's parts."""
    return max((p["seq"] for p in parts), default=0)


def _batch(number: int) -> int:
    return number if number >= 0 else -number - 1


__all__ = ["AlertTable", "BatchTable", "due"]
