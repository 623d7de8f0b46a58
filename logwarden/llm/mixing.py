"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target in words, divided by its size, is the expected number of
copies of each of its documents. The whole part is certain. The fractions are
rounded in pairs: a random transfer of words between two documents leaves one
of them a whole number and keeps the pair's sum. A source's documents are
dealt into buckets of bounded size; each leaves at most one fraction, and
the fractions are paired again, level by level, until each source has one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, n_words, stage

BUCKET_ROWS = 4096
FAN_IN = 256
#: Equal rows beyond this number are made in parts of as many.
REPEATED = 65_536
#: Decisions on up to this many documents are joined by broadcast (24 bytes each); beyond it the documents are shuffled.
BROADCAST_ROWS = 1_000_000


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Adds rank (by source, null last), and target to a table of source, source_size.

    The targets share the total size by weight; none exceeds cap times its
    source's size. Sources are sorted by cap / weight: the capped ones come
    first, and the level (words per unit of weight) of the first that isn't
    capped holds for all after it. One row per source, so one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("rank", rank)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("most") / F.col("w"), "rank")
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("spent", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))).withColumn("place", F.row_number().over(by))
    s = s.withColumn("level", (F.col("total") - F.col("spent")) / F.col("w_left"))
    fits = F.col("level") * F.col("w") <= F.col("most")
    s = s.withColumn("cut", F.min(F.when(fits, F.struct("place", "level"))).over(whole))
    return s.select("source", "source_size", "rows_", "rank", F.when(F.col("place") < F.col("cut.place"), F.col("most")).otherwise(F.col("cut.level") * F.col("w")).alias("target"))


def pivot(sizes: list[int], shares: list[float], draws: list[float]) -> list[float]:
    """Shares with all but at most one brought to 0.0 or 1.0; the sum of size times share stays. draws: a number in [0, 1) for each."""
    out = list(shares)
    held = -1
    for j in range(len(out)):
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        down_i = min(out[i] * sizes[i], (1 - out[j]) * sizes[j])
        down_j = min(out[j] * sizes[j], (1 - out[i]) * sizes[i])
        give = down_i if draws[j] * (down_i + down_j) < down_j else -down_j
        for k, words in ((i, -give), (j, give)):
            x = out[k] + words / sizes[k]
            out[k] = 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
        open_ = [k for k in (i, j) if 0.0 < out[k] < 1.0]
        held = open_[0] if open_ else -1
    return out


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns but maps, which have no order."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])


def _numbered(sized: DataFrame) -> DataFrame:
    """Equal rows as one, with their number; then as many rows again, with copy_ from 1. Rows that are equal to very many others are made in parts."""
    groups = sized.groupBy(*sized.columns).agg(F.count("*").alias("n_"))
    few = groups.where(F.col("n_") <= REPEATED).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_"))))
    parts = groups.where(F.col("n_") > REPEATED).withColumn("from_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_"), F.lit(REPEATED).cast("long"))))
    upto = F.least(F.col("from_") + REPEATED - 1, F.col("n_"))
    many = parts.repartition("from_").withColumn("copy_", F.explode(F.sequence(F.col("from_"), upto))).drop("from_")
    return few.unionByName(many).drop("n_")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, part_of_last: bool = True, content: Column | None = None) -> DataFrame:
    """How much of each document the mix takes.

    docs: doc_id, text, source. Returns doc_id, size, source_size, target,
    taken (words), copies (whole times; the document that is taken in part has
    the whole times before that part), source and content. Null text: no
    words, nothing taken. A null source is a source, the last one. Repeated
    rows count each, one row for each of them. With part_of_last, the
    one fraction that is left in each source is taken as that share of its
    document, so a source's words are within one of its target; else it is
    drawn, and they are within that document's size.

    The draws are hashes of doc_id, content (a hash of the row, by default of
    all its columns), a number among rows that are equal in these, and seed. So
    reruns agree in any order of the input, and a doc_id that many rows have,
    or null, is dealt like any other.
    """
    content = row_hash(docs) if content is None else content
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), content.alias("content")), "mix")
    sources = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows_")), weights, cap), "mix")
    most = sources.agg(F.max("rows_")).first()[0]
    known = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    each = _numbered(sized).alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    each = each.select("d.doc_id", "d.source", "d.content", "d.copy_", "d.size", "s.source_size", "s.target", "s.rank", "s.rows_")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    times = F.floor(want + 1e-12)
    each = each.withColumn("times", times.cast("long")).withColumn("share", F.greatest(want - times, F.lit(0.0)))
    each = each.withColumn("share", F.when((F.col("size") == 0) | (F.col("share") < 1e-12), 0.0).otherwise(F.col("share")))
    hashed = lambda x: F.xxhash64("doc_id", "content", "copy_", F.lit(x))
    drawn = lambda x: F.pmod(hashed(x), F.lit(1 << 52)).cast("double") / float(1 << 52)
    each = each.withColumn("draw", drawn(seed))
    each = each.withColumn("bucket", F.pmod(hashed(seed + 1), F.ceil(F.col("rows_") / bucket_rows)).cast("long")).drop("rows_")
    schema = each.schema

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "doc_id", "content", "copy_"], kind="stable")
        rows["share"] = pivot(rows["size"].tolist(), rows["share"].tolist(), rows["draw"].tolist())
        return rows

    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    each = stage(each, "mix")
    done, current, buckets = each.where(~open_), each.where(open_), math.ceil((most or 0) / bucket_rows)
    parts = []
    step = 0
    while True:
        step += 1
        got = stage(current.groupBy("rank", "bucket").applyInPandas(level, schema), "mix")
        parts.append(got.where(~open_))
        current = got.where(open_)
        if buckets <= 1:
            break
        buckets = math.ceil(buckets / fan_in)
        # Another draw for each level, else a pair's draws would be those that left these rows open.
        current = current.withColumn("bucket", F.floor(F.col("bucket") / fan_in)).withColumn("draw", drawn(seed + 1 + step))
    if not part_of_last:
        current = current.withColumn("share", F.when(F.col("draw") < F.col("share"), 1.0).otherwise(0.0))
    out = done
    for p in [*parts, current]:
        out = out.unionByName(p)
    drop_stage(sized)
    return out.select("doc_id", "size", "source_size", "target", F.round((F.col("times") + F.col("share")) * F.col("size")).cast("long").alias("taken"), (F.col("times") + F.floor("share")).cast("long").alias("copies"), "source", "content")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, whole documents only, with all its columns.

    Null texts are not taken. Rows that are equal in all columns are one
    document that occurs several times, and share their copies; rows with equal
    doc_id that differ are documents of their own. Names of columns may be
    any. An empty table gives an empty one.
    """
    names = docs.columns
    own = {c: f"in{i}_" for i, c in enumerate(names)}
    cols = list(own.values())
    rows = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in names])
    key, whole = F.col(own["doc_id"]), row_hash(rows)
    asked = rows.select(key.alias("doc_id"), F.col(own["text"]).alias("text"), F.col(own["source"]).alias("source"), whole.alias("content"))
    chosen = mix(asked, part_of_last=False, content=F.col("content"), **options).groupBy("doc_id", "content").agg(F.sum("copies").alias("copies_"), F.count("*").alias("rows_"))
    chosen = stage(chosen.where("copies_ > 0"), "mix")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    one = rows.withColumn("whole_", whole).join(chosen, key.eqNullSafe(F.col("doc_id")) & (F.col("whole_") == F.col("content"))).drop("doc_id", "content")
    alone = one.where("rows_ = 1").select(*cols, F.col("copies_").alias("n_"))
    # Equal rows are numbered by the places they come from, so that no task gets all of them.
    several = stage(one.where("rows_ > 1").withColumn("id_", F.monotonically_increasing_id()).withColumn("sub_", F.shiftright("id_", 16)), "mix")
    group = [own["doc_id"], "whole_"]
    before = F.sum("k_").over(Window.partitionBy(*group).orderBy("sub_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = several.groupBy(*group, "sub_").agg(F.count("*").alias("k_")).withColumn("before_", F.coalesce(before, F.lit(0))).select(F.col(group[0]).alias("g_"), F.col("whole_").alias("w_"), F.col("sub_").alias("s_"), "before_")
    ranked = several.withColumn("k_", F.row_number().over(Window.partitionBy(*group, "sub_").orderBy("id_")))
    ranked = ranked.join(offsets, F.col(group[0]).eqNullSafe(F.col("g_")) & (F.col("whole_") == F.col("w_")) & (F.col("sub_") == F.col("s_")))
    n = F.floor(F.col("copies_") / F.col("rows_")) + F.when(F.col("before_") + F.col("k_") <= F.col("copies_") % F.col("rows_"), 1).otherwise(0)
    out = alone.unionByName(ranked.select(*cols, n.alias("n_"))).select(*cols, F.explode(F.array_repeat(F.lit(0), F.col("n_").cast("int"))).alias("i_"))
    return out.select(*[F.col(own[c]).alias(c) for c in names])
