"""Tables on disk: appends by partition, and versions behind numbered pointers for tables that change in place."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Columns by whose values single rows are looked up; files have Bloom filters of them.
LOOKED_UP = ("event_id", "alert_id", "dedup_key")


def writer(rows: DataFrame) -> DataFrameWriter:
    """A writer whose files tell which values of LOOKED_UP they can't hold, so that a look-up reads few of their row groups. The filters' size follows what is in a file."""
    out = rows.write
    for c in LOOKED_UP:
        if c in rows.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    return out


def append_events(events: DataFrame, path: str) -> None:
    """Appends by source batch. The write's own id is in the file names, not in the rows."""
    writer(events).mode("append").partitionBy("source_batch").parquet(path)


def append_once(rows: DataFrame, path: str, batch_id: int, order: tuple[str, ...] = ()) -> None:
    """A micro-batch in a folder of its own, overwritten if the batch is run again: so retries add nothing twice. Rows are sorted by order in each file, which then have narrow ranges of it."""
    writer(rows.sortWithinPartitions(*order) if order else rows).mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one in the warehouse."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_landed"


def land(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Writes rows to path, unless they are there as a whole, and reads them back."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        writer(rows.sortWithinPartitions(*order) if order else rows).mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def swap(spark: SparkSession, fresh: str, folder: str) -> None:
    """Puts the folder fresh in another's place. A run that ends in between leaves the old one beside it, under a name that readers pass over (they read names with =) and recover() finds."""
    top, name = folder.rsplit("/", 1)
    old = f"{top}/_old-{uuid.uuid4().hex}-{name.replace('=', '~')}"
    at, new, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, fresh, old))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(at, aside) or not fs.rename(new, at):
        raise RuntimeError(f"{folder} could not be replaced; its rows are in {old} or in place")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> int:
    """Puts back folders that a swap had moved aside when its run ended, and removes what it had replaced or not used; how many were put back."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    back = 0
    for s in fs.listStatus(top) if fs.exists(top) else []:
        at = s.getPath()
        if m := re.fullmatch(r"_old-[0-9a-f]{32}-(.+)", at.getName()):
            home = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{m[1].replace('~', '=')}")
            if fs.exists(home):
                fs.delete(at, True)
            elif fs.rename(at, home):
                back += 1
        elif at.getName().startswith("_new-"):
            fs.delete(at, True)
    return back


def rewrite(kept: DataFrame, path: str, batches: list[int]) -> None:
    """Puts kept, the rows of these micro-batches that stay, in their folders' place: one job for all of them, then a rename each. A folder without rows goes."""
    spark = kept.sparkSession
    fresh = f"{path}/_new-{uuid.uuid4().hex}"
    writer(kept.repartition("micro_batch")).partitionBy("micro_batch").parquet(fresh)
    for batch in batches:
        folder = f"micro_batch={batch}"
        if exists(spark, f"{fresh}/{folder}"):
            swap(spark, f"{fresh}/{folder}", f"{path}/{folder}")
        else:
            remove(spark, f"{path}/{folder}")
    remove(spark, fresh)


def remove_where(spark: SparkSession, path: str, condition: Column, schema: StructType | None = None) -> int:
    """Deletes the rows of a table in micro-batch folders for which condition is true; the number of them. Only folders that hold such rows are written again, all in one job."""
    if not exists(spark, path):
        return 0
    recover(spark, path)
    table = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    gone = {r[0]: r[1] for r in table.where(condition).groupBy("micro_batch").agg(F.count("*")).collect()}
    if gone:
        rewrite(table.where(F.col("micro_batch").isin(list(gone)) & ~F.coalesce(condition, F.lit(False))), path, list(gone))
    return sum(gone.values())


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class VersionedTable:
    """A table whose contents are what its current version names: folders of rows (parts), and a note.

    A numbered pointer holds both; it is renamed into place when the folders
    are whole, and the highest number is the current one. Nothing that is
    current is ever removed or moved, so a reader, or a run after a crash,
    finds the old or the new version with its own note. The parts of the two
    last versions stay, for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self) -> list[str]:
        fs, top = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []

    def _pointers(self) -> list[str]:
        return sorted(n for n in self._names() if n.startswith("current-"))

    def _pointer(self, name: str) -> dict:
        fs, at = self._fs(name)
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _current(self) -> dict:
        found = self._pointers()
        return self._pointer(found[-1]) if found else {"parts": [], "note": {}}

    def parts(self) -> list[dict]:
        """The current parts, in their order: each has its folder, as dir, and what its writer said of it."""
        return self._current()["parts"]

    def rows_of(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p['dir']}" for p in parts])

    def read(self) -> DataFrame:
        return self.rows_of(self.parts())

    def note(self) -> dict:
        """What the current version's writer noted; empty if there is none."""
        return self._current()["note"]

    def write(self, rows: DataFrame, by: str | None = None) -> str:
        """Writes rows to a folder of their own, which is no part yet; with by, a folder in it for each value of that column."""
        name = f"v-{uuid.uuid4().hex}"
        out = writer(rows)
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}")
        return name

    def commit(self, parts: list[dict], note: dict | None = None) -> None:
        """These parts, and the note with them, are the table from here on. One writer at a time."""
        before = self._pointers()
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        fs, tmp = self._fs(f"tmp-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps({"parts": parts, "note": note or {}}).encode()))
        out.close()
        _, at = self._fs(f"current-{number:020}")
        if not fs.rename(tmp, at):
            raise RuntimeError(f"another writer has replaced {self.path}")
        keep = {f"current-{number:020}", *before[-1:]}
        # A part may be a folder within one that a single job has written.
        held = {p["dir"].split("/")[0] for n in keep for p in self._pointer(n)["parts"]}
        for name in self._names():
            if name not in keep | held:
                _, old = self._fs(name)
                fs.delete(old, True)

    def replace(self, rows: DataFrame, note: dict | None = None, beside: list[dict] | tuple = (), said: dict | None = None) -> None:
        """The rows, as one part of which said tells, behind the parts beside are the table from here on."""
        self.commit([*beside, {"dir": self.write(rows), **(said or {})}], note)


def by_batch(events: DataFrame, label: str) -> DataFrame:
    """Rows of one batch; the scan reads its partition only."""
    return events.where(F.col("source_batch") == label)
