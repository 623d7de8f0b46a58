"""Importance resampling towards a target, by external sort-count.

Features are runs of words, hashed to buckets. The corpus is hashed once and
written as packed streams: a row holds several whole documents' buckets, two
bytes each, one document after another, and where each begins. To count, each
stream is sorted and run-length encoded, and Spark adds the runs of all
streams. Then the stored streams are read again, and each document's gains are
gathered and added by np.add.reduceat. Gumbel noise by a hash of the id turns
the highest scores into a draw without replacement. Ranks are places in a
range-partitioned order: no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, fields, map_rows, stage

BUCKETS = 10_000
#: Bytes of one text that are split into words at a time.
PIECE = 1 << 20
#: Rows, about, of a task that ranks, at most.
RANGE_ROWS = 500_000
#: Letters and digits stay, A-Z in lower case, as do all bytes of other characters; the rest of ASCII separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets_of(text: bytes, longest: int = 2, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all runs of 1 to longest words, in no certain order. Long texts are taken a piece at a time."""
    out, total, before, at = [], 0, [], 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_FOLD)
        while end < len(text) and piece[-1] != 32:  # a word is never cut
            more = text[end : end + PIECE].translate(_FOLD)
            stop = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:stop], end + stop
        at = end
        new = piece.split()
        total += len(new)
        words, held = before + new, len(before)
        sums = list(map(crc32, words))
        for n in range(1, longest + 1):
            # Runs of n words by their starts; those that end among the words held over came with the last piece.
            out.append(np.array(sums[max(0, held - n + 1) :], np.uint32) % np.uint32(buckets))
            if n < longest:
                sums = list(map(crc32, words[n:], map(crc32, repeat(b" "), sums)))
        before = words[len(words) - min(longest - 1, len(words)) :]
    return total, np.concatenate(out).astype(np.uint16) if out else np.empty(0, np.uint16)


def bucket_streams(docs: DataFrame, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_ids, n_words, offsets and stream: packed uint16 buckets of several whole documents, and where each one's begin. docs: doc_id, text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is two bytes")
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = fields(("doc_ids", f"array<{ids}>"), ("n_words", "array<bigint>"), ("offsets", "array<bigint>"), ("stream", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            counts, parts = [], []
            for text in b.column("text"):
                n, own = buckets_of(text.as_buffer().to_pybytes() if text.is_valid else b"", longest, buckets)
                counts.append(n)
                parts.append(own)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
            stream = pa.array([np.concatenate(parts).astype("<u2").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([one(b.column("doc_id"), None), one(counts, pa.int64()), one(offsets, pa.int64()), stream], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """bucket and n: each stream is sorted and run-length encoded, and the runs of all are added."""

    def encode(batches):
        for rows in batches:
            for (data,) in rows:
                order = np.sort(np.frombuffer(data, "<u2"), kind="stable")
                if len(order):
                    starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
                    yield from zip(order[starts].tolist(), np.diff(np.append(starts, len(order))).tolist(), strict=True)

    runs = map_rows(streams.select("stream"), encode, fields(("bucket", "int"), ("n", "bigint")), 32_768)
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of the smoothed ratio of shares, target to source, by bucket. Both are (bucket, n): at most one row a bucket comes to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for to, df in ((s, source), (t, target)):
        for r in df.collect():
            to[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of its features' gains; 0 without features."""
    ids = streams.schema["doc_ids"].dataType.elementType.simpleString()
    schema = fields(("doc_id", ids), ("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids_, words, offsets = (b.column(c)[i].values for c in ("doc_ids", "n_words", "offsets"))
                stream = np.frombuffer(b.column("stream")[i].as_buffer(), "<u2")
                starts = offsets.to_numpy()
                n = np.diff(np.append(starts, len(stream)))
                weight, some = np.zeros(len(n), np.int64), n > 0
                if some.any():  # the places of empty ones would split their neighbours
                    weight[some] = np.add.reduceat(gains[stream], starts[some]) // n[some]
                yield pa.RecordBatch.from_arrays([ids_, words, pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=schema.names)

    return streams.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = 7) -> Column:
    """floor(1000 * Gumbel noise), from a hash of the seed and the id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """rows with place_, from 1 on, in the order.

    Rows are dealt by ranges of it and written with their range's number; a
    range's first place is the number of rows before it. Rows that tie in
    order are told apart by a number, so that a third of all rows may be equal.
    """
    numbered = rows.withColumn("tie_", F.xxhash64(F.monotonically_increasing_id()))
    dealt = numbered.repartitionByRange(partitions, *order, "tie_").withColumn("range_", F.spark_partition_id())
    held = stage(dealt, "ranked")
    before, firsts = 0, []
    for r in sorted(held.groupBy("range_").count().collect()):
        firsts.append((r[0], before))
        before += r[1]
    spark = rows.sparkSession
    first = spark.createDataFrame(firsts, "range_ int, before_ bigint")
    inside = F.row_number().over(Window.partitionBy("range_").orderBy(*order, "tie_"))
    return held.withColumn("place_", inside).join(F.broadcast(first), "range_").withColumn("place_", F.col("place_") + F.col("before_")).drop("range_", "tie_", "before_")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; undrawn rows have a null rank.

    docs: doc_id, text; target: text. floor(percent * N / 100) of the N rows
    with min_words words or more are drawn, by score, ties to smaller ids.
    Null and empty texts have no features and weight 0. Each of several equal
    rows is scored, and may be drawn, by itself; rows that tie in all of score,
    id and n_features are equal but for their ranks. A null id comes last among
    ties. An empty table, on either side, is a table without features.
    """
    streams = stage(bucket_streams(docs, longest, buckets), "streams")
    texts = target.select(F.lit(0).alias("doc_id"), "text")
    gains = bucket_gains(bucket_counts(streams), bucket_counts(bucket_streams(texts, longest, buckets)), buckets)
    scored = weigh(streams, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stage(scored.withColumn("open_", F.col("n_words") >= min_words), "scored")
    n, candidates = scored.agg(F.count("*"), F.count_if("open_")).first()
    order = [F.col("open_").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(scored, order, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place_") <= percent * candidates // 100, F.col("place_")).cast("long").alias("rank"))
