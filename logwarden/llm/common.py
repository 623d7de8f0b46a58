"""Helpers that the training-data operators share: staging tables, row batches, components."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a longest run of characters other than space and \x09-\x0D. On UTF-8
#: bytes this is exactly bytes.split().
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that by_bytes() gives at a time.
BATCH_BYTES = 8 << 20
#: Short rows that a task of stage() should write at least, where their number is known.
FILE_ROWS = 50_000
#: Rows that map_rows() turns into Python objects at a time.
ROWS = 256


def n_words(text: Column) -> Column:
    """Number of words; null counts as no words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where all folders are shared, one in the warehouse if it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def file_tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks write so many short rows: as many as there are cores, and of FILE_ROWS at most."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    rows: as many as df can have at most, if that is known. Shuffles of little
    data into many partitions then don't end in a file for each: the last step
    of df's plan, which should be a plain one, runs in tasks of FILE_ROWS. Where there are
    more rows than that in a partition, nothing changes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(file_tasks(spark, rows))).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def drop_stage(df: DataFrame) -> None:
    """Removes a staged table that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stages(spark: SparkSession) -> None:
    """Removes all staged tables of this application; for callers that have written their results elsewhere."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def map_rows(df: DataFrame, fn: Callable[..., Iterator[tuple]], schema: T.StructType, batch_rows: int = 4096) -> DataFrame:
    """mapInArrow over Python rows.

    fn gets an iterator of row batches (lists of tuples in df's column order)
    and yields output tuples; these are sent on in bounded batches.
    """
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        # Few rows and bytes at a time are Python objects; long texts would fill a worker's memory otherwise.
        for row in fn(list(zip(*(c.to_pylist() for c in p.columns), strict=True)) for b in batches for p in slices(b, BATCH_BYTES, ROWS)):
            out.append(row)
            held += sum(map(_size, row))
            if len(out) >= batch_rows or held >= BATCH_BYTES:
                yield _batch(out, names, arrow)
                out, held = [], 0
        if out:
            yield _batch(out, names, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _size(v) -> int:
    """Characters or bytes of a value, those within a list included."""
    return len(v) if isinstance(v, (str, bytes)) else sum(map(_size, v)) + len(v) if isinstance(v, list) else 0


def _lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; of those other than texts, binaries and lists of them, none."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) and len(column):
        sums = np.concatenate([[0], np.cumsum(_lengths(column.values))])
        at = column.offsets.to_numpy()
        return sums[at[1:]] - sums[at[:-1]]
    return np.zeros(len(column), np.int64)


def slices(batch: pa.RecordBatch, most_bytes: int, most_rows: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and about so many bytes in columns (all by default), or one longer row."""
    size = sum((_lengths(batch.column(c)) for c in columns or range(batch.num_columns)), np.zeros(batch.num_rows, np.int64))
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        room = (ends[i - 1] if i else 0) + most_bytes
        j = min(i + most_rows, max(i + 1, int(np.searchsorted(ends, room, "right"))), len(size))
        yield batch.slice(i, j - i)
        i = j


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about BATCH_BYTES of text, or one longer row."""
    for b in batches:
        yield from slices(b, BATCH_BYTES, max(1, b.num_rows), [text])


def by_key(batches: Iterator[list[tuple]], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows) of consecutive rows with equal first width columns; each rows is to be used up before the next."""
    return itertools.groupby(itertools.chain.from_iterable(batches), key=lambda r: r[:width])


def fields(*pairs: tuple[str, str]) -> T.StructType:
    """A schema from (name, type) pairs; types are DDL strings."""
    out = T.StructType()
    for name, kind in pairs:
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def components(edges: DataFrame, max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """Smallest reachable node of every node with a link.

    edges: two long columns a, b (any order, repeats allowed), most of them at
    most, if that is known. Returns (node, component). Alternates large-star and small-star steps; both are grouped
    minima, so a hub's links are reduced before the shuffle, and no task
    gathers a hub's neighbours. Each round is staged. Stops when nothing
    changes; an exceeded max_rounds is an error, never a partial result.
    """
    spark = edges.sparkSession
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage(e, "cc", most)
    measured = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = measured(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above u is linked with u's smallest neighbour (or u).
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: all neighbours below u, and u, are linked with the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        # A step makes a link for each of a round's links, and one for each of their nodes, at most.
        new = stage(small, "cc", 3 * before[0])
        after = measured(new)
        drop_stage(e)
        e = new
        if before == after:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError("components did not settle")
