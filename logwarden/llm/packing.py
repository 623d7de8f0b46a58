"""Packing token sequences by non-negative least squares.

Documents are cut into whole windows and a remainder. The histogram of
remainder lengths, rounded up to a grain, is covered by shallow combinations
(two or three lengths, or one, that fill a window): non-negative least squares
finds how often to repeat each, the counts are rounded down, and what is left
is packed greedily end to end, where documents may be cut. The tail of that
stream becomes sequences whose lengths are powers of two, so it has no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Ids
from .common import by_bytes, drop_stage, fields, map_rows, stage

WINDOW = 4096
GRAIN = 16
#: Consecutive rows of a partition that are ranked together: 2^16.
RANKED_BITS = 16
#: Cut documents up to this number are joined by broadcast (16 bytes each).
BROADCAST_CUTS = 200_000


def combinations(bins: int) -> np.ndarray:
    """All ways to fill a window of so many grains by one to three lengths: rows of non-increasing lengths, 0 for none."""
    out = [(bins, 0, 0)]
    for a in range(bins - 1, 0, -1):
        for b in range(min(a, bins - a), 0, -1):
            c = bins - a - b
            if c <= b:
                out.append((a, b, c))
    return np.array(out, np.int64)


def nnls(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring their use of each length near the histogram in the least squares.

    Multiplicative updates (the least-squares form for non-negative data):
    each x is scaled by (A'h) / (A'Ax). A is sparse, three entries a row.
    """
    n = len(histogram)
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), n) * (np.arange(n) > 0)
    back = lambda y: y[rows].sum(1)
    h = histogram.astype(float).copy()
    h[0] = 0
    x = np.where(h[rows].sum(1) > 0, 1.0, 0.0)
    for d in range(3):
        x[(rows[:, d] > 0) & (h[rows[:, d]] == 0)] = 0
    x *= h.sum() / max(used(x).sum(), 1)
    target = back(h)
    for _ in range(rounds):
        x *= target / np.maximum(back(used(x)), 1e-12)
    return x


def rounded(rows: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole counts within the histogram: x rounded down, then combinations by falling x once or more while their lengths are left."""
    left = histogram.astype(np.int64).copy()
    left[0] = np.iinfo(np.int64).max // 4
    counts = np.zeros(len(rows), np.int64)
    for want in (np.floor(x).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):
        for k in np.argsort(-x, kind="stable"):
            parts = rows[k][rows[k] > 0]
            uses = {int(p): int((parts == p).sum()) for p in parts}
            n = min(int(want[k]), *(left[p] // u for p, u in uses.items()))
            if n > 0:
                counts[k] += n
                for p, u in uses.items():
                    left[p] -= n * u
    return counts


def pack(docs: DataFrame, tokenizer: str, end: int = 2, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Packs all documents into sequences of at most window tokens.

    docs: doc_id and text; other columns are not read. Null text: as empty,
    so its only id is end. Rows with equal doc_id are packed each; a null
    doc_id is kept as null. Returns one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. No row for an empty table.

    The texts are never shuffled, except those of cut documents if there are
    more of them than a broadcast may hold. A length bin's rows are ranked by
    the places they come from, at most 2^RANKED_BITS in a group, however many
    the bin has. What goes to the driver is a row for each of the window /
    grain bins.
    """
    spark = docs.sparkSession
    bins = window // grain
    kind = docs.schema["doc_id"].dataType.simpleString()
    # 1. Tokens, and the checksum of each whole window and of the remainder.
    schema = fields(("doc_id", kind), ("text_", "bigint"), ("n", "bigint"), ("crcs", "array<bigint>"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_"), "text")
    sized = keyed.mapInArrow(_measure(tokenizer, end, window, schema), schema)
    sized = sized.withColumn("row_", F.monotonically_increasing_id())
    sized = stage(sized.withColumn("full", F.floor(F.col("n") / window)).withColumn("rest", F.col("n") % window).withColumn("bin", F.ceil(F.col("rest") / grain).cast("int")), "pack")

    # 2. Ranks within each bin. sub is a stretch of a partition's rows; offsets come from the sums of (bin, sub) within a bin, and of the bins.
    dealt = sized.withColumn("sub", F.shiftright("row_", RANKED_BITS))
    before = Window.partitionBy("bin").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("bin", "sub").agg(F.count("*").alias("rows_"), F.sum("full").alias("fulls"))
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = stage(sums.select("bin", "sub", earlier("rows_").alias("rank0"), earlier("fulls").alias("full0"), "rows_", "fulls"), "pack")
    hist = np.zeros(bins + 1, np.int64)
    fulls = np.zeros(bins + 1, np.int64)
    for b, n, f in offsets.groupBy("bin").agg(F.sum("rows_"), F.sum("fulls")).collect():
        hist[b], fulls[b] = n if b else 0, f
    n_full = int(fulls.sum())
    bin_full = F.element_at(F.array(*[F.lit(int(x)) for x in np.cumsum(fulls) - fulls]), F.col("bin") + 1)
    in_sub = Window.partitionBy("bin", "sub").orderBy("row_")
    ranked = dealt.withColumn("r", F.row_number().over(in_sub) - 1).withColumn("f", F.coalesce(F.sum("full").over(in_sub.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(offsets.select("bin", "sub", "rank0", "full0"), ["bin", "sub"]).withColumn("rank", F.col("rank0") + F.col("r")).withColumn("full_at", bin_full + F.col("full0") + F.col("f"))

    # 3. Combinations, repeat counts and their slots: ranks [first, last) of a bin fill place p of the sequences from seq0 on.
    rows = combinations(bins)
    counts = rounded(rows, nnls(rows, hist), hist)
    slots, taken, seq = [], np.zeros(bins + 1, np.int64), n_full
    for k in np.flatnonzero(counts):
        for place, b in enumerate(rows[k][rows[k] > 0]):
            slots.append((int(b), int(taken[b]), int(taken[b] + counts[k]), int(seq), place))
            taken[b] += counts[k]
        seq += counts[k]
    slot_rows = spark.createDataFrame(slots, "bin_ int, first long, last long, seq0 long, place int")
    placed = ranked.join(F.broadcast(slot_rows), (F.col("bin") == F.col("bin_")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")), "left")
    placed = stage(placed.select("doc_id", "text_", "row_", "bin", "sub", "n", "crcs", "full", "rest", "full_at", (F.col("seq0") + F.col("rank") - F.col("first")).alias("seq"), "place"), "pack")
    drop_stage(sized)
    drop_stage(offsets)

    piece = lambda start, length, crc, seq, offset: [F.col("doc_id"), start.cast("long").alias("start"), length.cast("long").alias("length"), crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"), seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset")]
    whole = placed.where("full > 0").select("*", F.posexplode(F.slice("crcs", 1, F.col("full").cast("int"))).alias("i", "crc"))
    whole = whole.select(*piece(F.col("i") * window, F.lit(window), F.col("crc"), F.col("full_at") + F.col("i"), F.lit(0)))
    in_seq = Window.partitionBy("seq").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last_crc = F.element_at("crcs", -1)
    combined = placed.where("seq is not null").withColumn("at", F.coalesce(F.sum("rest").over(in_seq), F.lit(0)))
    combined = combined.select(*piece(F.col("full") * window, F.col("rest"), last_crc, F.col("seq"), F.col("at")))

    # 4. The others end to end, bin after bin.
    left = placed.where("seq is null and rest > 0").select("doc_id", "text_", "row_", "bin", "sub", "n", "full", "rest", last_crc.alias("crc"))
    sub_sums = left.groupBy("bin", "sub").agg(F.sum("rest").alias("tokens"))
    stream = stage(sub_sums.select("bin", "sub", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("pos0"), "tokens"), "pack")
    in_bin = np.zeros(bins + 1, np.int64)
    for b, n in stream.groupBy("bin").agg(F.sum("tokens")).collect():
        in_bin[b] = n
    tokens = int(in_bin.sum())
    bin_pos = F.element_at(F.array(*[F.lit(int(x)) for x in np.cumsum(in_bin) - in_bin]), F.col("bin") + 1)
    at = F.coalesce(F.sum("rest").over(in_sub.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("at", at).join(stream.select("bin", "sub", "pos0"), ["bin", "sub"]).withColumn("pos", bin_pos + F.col("pos0") + F.col("at"))
    tail0, tail = tokens - tokens % window, tokens % window
    marks, p = [], tail0
    for bit in range(window.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            marks.append(p)
            p += 1 << bit
    marks_c = F.array(*[F.lit(m).cast("long") for m in marks]) if marks else F.array().cast("array<bigint>")
    stop = F.col("pos") + F.col("rest")
    first_mark = (F.floor(F.col("pos") / window) + 1) * window
    inner = F.when(first_mark < stop, F.sequence(first_mark, stop, F.lit(window))).otherwise(F.array().cast("array<bigint>"))
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.col("pos").cast("long")), inner.cast("array<bigint>"), marks_c), lambda x: (x >= F.col("pos")) & (x < stop))))
    left = left.withColumn("cuts", cuts)
    ends = F.concat(F.slice("cuts", 2, F.greatest(F.size("cuts") - 1, F.lit(0))), F.array(stop.cast("long")))
    left = left.select("*", F.size("cuts").alias("n_cuts"), F.posexplode(F.arrays_zip(F.col("cuts").alias("a"), ends.alias("b"))).alias("i", "c"))
    in_tail = F.size(F.filter(marks_c, lambda m: m <= F.col("c.a")))
    seq0 = F.when(in_tail > 0, F.lit(tail0 // window) + in_tail - 1).otherwise(F.floor(F.col("c.a") / window))
    offset = F.when(in_tail > 0, F.col("c.a") - F.array_max(F.filter(marks_c, lambda m: m <= F.col("c.a")))).otherwise(F.col("c.a") % window)
    left = stage(left.select("doc_id", "text_", "n", (F.col("full") * window + F.col("c.a") - F.col("pos")).alias("start"), (F.col("c.b") - F.col("c.a")).alias("length"), F.when(F.col("n_cuts") == 1, F.col("crc")).alias("crc"), (F.lit(int(seq)) + seq0).alias("seq"), offset.alias("offset")), "pack")
    drop_stage(stream)
    uncut = left.where("crc is not null").select(*piece(F.col("start"), F.col("length"), F.col("crc"), F.col("seq"), F.col("offset")))
    cut = _checksums(keyed, left.where("crc is null"), tokenizer, end).select(*piece(F.col("start"), F.col("length"), F.col("got"), F.col("seq"), F.col("offset")))
    return whole.unionByName(combined).unionByName(uncut).unionByName(cut)


def _measure(tokenizer: str, end: int, window: int, schema: T.StructType):
    """Rows of schema, in mapInArrow, for (doc_id, text_, text): the number of ids, and the checksum of each window's."""

    def run(batches):
        table = Ids(tokenizer)
        for b in by_bytes(batches):
            sizes, sums = [], []
            for ids in table.of_texts(b.column("text"), end):
                sizes.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
            made = [b.column("doc_id"), b.column("text_"), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

    return run


def _checksums(keyed: DataFrame, pieces: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """pieces with the checksum got of each; only documents with pieces are tokenized again."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & F.col(f"{a}.text_").eqNullSafe(F.col(f"{b}.text_"))
    wanted = pieces.groupBy("doc_id", "text_").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    n = pieces.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST_CUTS else wanted
    found = keyed.alias("k").join(wanted.alias("w"), same("k", "w")).select("k.doc_id", "k.text_", "k.text", "w.parts")
    schema = fields(("doc_id", kind), ("text_", "bigint"), ("start", "bigint"), ("length", "bigint"), ("got", "bigint"))

    def run(batches):
        table = Ids(tokenizer)
        for rows in batches:
            texts = pa.array([r[2] for r in rows], pa.string())
            for (doc_id, h, _, parts), ids in zip(rows, table.of_texts(texts, end), strict=True):
                for p in parts:
                    yield doc_id, h, p["start"], p["length"], zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])

    got = map_rows(found, run, schema).distinct()
    return pieces.alias("p").join(got.alias("g"), same("p", "g") & (F.col("p.start") == F.col("g.start")) & (F.col("p.length") == F.col("g.length"))).select("p.*", "g.got")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
