"""MinHash near-duplicates by an LSH forest.

Every document's signature is read in several orders, one for each tree. In a
tree, documents are sorted by their signature; those that share the longest
prefixes are neighbours. A region is a run with a common prefix: shallow where
few documents share it, deeper where many do. Regions give candidates; a
region is narrowed by the whole signatures, and its links are confirmed on
the full shingle sets. Documents with equal sets are one class from the start,
and only one of each class is in the forest.

Runs that are too long for one region are crowds: pages of one boilerplate,
say. What the forest has left apart in them is joined by the rarest shingles of
each document, so that a crowd costs what its members have of their own, and
not its square.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, ROWS, by_key, components, drop_stage, fields, map_rows, release, slices, stage

SHINGLE = 5
TREES = 12
DEPTH = 6
#: Levels of a tree that the documents of a region share at least.
LEAST_DEPTH = 2
#: A run with more documents is split at the next level.
REGION = 64
#: Rows of a run that are held at once; a longer run is cut, with an overlap of a region.
HELD = 65_536
#: Most classes, and shingles, of a block of a crowd.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Signatures that agree in a smaller share are not compared further: four deviations below a similarity of 0.75.
LEAST_AGREEMENT = 0.54
#: Most of a crowd's commonest shingles that tasks know of; 16 bytes each.
MOST_COMMON = 1 << 19
#: Candidate documents up to this number are joined by broadcast.
BROADCAST_ROWS = 200_000
_CACHE = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """UTF-8 word -> its 64-bit hash as 8 bytes; bounded like any cache."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits, so that polynomial hashes have random high bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, table: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z in lower case."""
    words = (text or "").encode().lower().split()
    w = np.frombuffer(b"".join(map(table.__getitem__, words)), np.uint64)
    n = len(w)
    if not n:
        return w
    k = size if n >= size else n
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = h * _BASE + w[i : n - k + 1 + i]
    return np.unique(mixed(h))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


_A, _B = _permutations(TREES * DEPTH)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each non-empty set under TREES * DEPTH permutations, as 32 bits."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for i in range(TREES * DEPTH):
        out[:, i] = np.minimum.reduceat(((flat * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _keys(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit key (k1, k2) and the signature; these are null for an empty set."""
    schema = fields(("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_shingles", "bigint"), ("k1", "bigint"), ("k2", "bigint"), ("sig", "binary"))

    def run(batches):
        table = WordHashes()

        def flush(held: list) -> Iterator[tuple]:
            some = [s for _, s in held if len(s)]
            sigs = iter(signatures(some)) if some else iter(())
            for doc_id, s in held:
                yield (doc_id, len(s), *_keys(s), next(sigs).astype(">u4").tobytes()) if len(s) else (doc_id, 0, None, None, None)

        held, n = [], 0
        for rows in batches:
            for doc_id, text in rows:
                s = shingles(text, table)
                held.append((doc_id, s))
                n += len(s)
                if n >= 1 << 18 or len(held) >= 4096:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return map_rows(docs.select("doc_id", "text"), run, schema)


def split(run: list[tuple[bytes, int]], level: int = 0, deepest: int = DEPTH - LEAST_DEPTH) -> Iterator[list[int]]:
    """Regions of a sorted run of (further levels, class): the run itself if small, else its parts by the next level, and the first of each part with its neighbours'."""
    if len(run) <= REGION:
        if len(run) > 1:
            yield [c for _, c in run]
        return
    if level == deepest:
        step = REGION * 3 // 4
        for i in range(0, len(run) - (REGION - step), step):
            yield [c for _, c in run[i : i + REGION]]
        return
    parts: list[list[tuple[bytes, int]]] = []
    for row in run:
        if parts and parts[-1][0][0][4 * level : 4 * level + 4] == row[0][4 * level : 4 * level + 4]:
            parts[-1].append(row)
        else:
            parts.append([row])
    for p in parts:
        yield from split(p, level + 1, deepest)
    if len(parts) > 1:
        heads = [p[0] for p in parts]
        yield from split(heads, deepest, deepest)


def _heads(classes: DataFrame) -> DataFrame:
    """crowd (a tree and its first levels, hashed), rest (the further levels) and k1 of each class in each tree."""
    width, head = 4 * DEPTH, 4 * LEAST_DEPTH
    part = lambda a, n: f"substring(sig, t * {width} + {a + 1}, {n})"
    trees = F.expr(f"inline(transform(sequence(0, {TREES - 1}), t -> named_struct('crowd', xxhash64(t, {part(0, head)}), 'rest', {part(head, width - head)})))")
    return classes.select("k1", trees)


def _crowded(classes: DataFrame, most: int) -> DataFrame:
    """crowd and n of the heads that more classes, of which there are most at most, share than a region holds."""
    return stage(_heads(classes).groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > REGION), "near", TREES * most // REGION)


def _regions(classes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Distinct regions (region, members: classes by their k1) of all trees. A crowd that one task shouldn't sort is dealt to several; what these part is found as a crowd."""

    def cut(batches):
        for _, rows in by_key(batches, 2):
            held: list[tuple[bytes, int]] = []
            for _, _, rest, k1 in rows:
                held.append((rest, k1))
                if len(held) >= HELD:
                    yield from each(held)
                    held = held[-REGION:]
            yield from each(held)

    def each(run):
        for members in split(run):
            members = sorted(set(members))
            if len(members) > 1:
                yield xxhash.xxh3_64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63), members

    large = crowded.where(F.col("n") > HELD).select(F.col("crowd").alias("crowd_"), F.ceil(F.col("n") / HELD).alias("parts"))
    n = large.count()
    trees = _heads(classes)
    if n:
        trees = trees.join(F.broadcast(large) if n <= BROADCAST_ROWS else large, F.col("crowd") == F.col("crowd_"), "left")
    sub = F.pmod(F.xxhash64("k1"), F.coalesce("parts", F.lit(1))).cast("int") if n else F.lit(0)
    dealt = trees.select("crowd", sub.alias("sub"), "rest", "k1").repartition("crowd", "sub").sortWithinPartitions("crowd", "sub", "rest", "k1")
    return map_rows(dealt, cut, fields(("region", "bigint"), ("members", "array<bigint>"))).dropDuplicates(["region"])


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _narrowed(regions: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct groups within regions that are connected by signatures that agree enough."""
    rows = regions.select("region", F.explode("members").alias("k1")).join(classes.select("k1", "sig"), "k1").select("region", "k1", "sig")

    def run(batches):
        for _, group in by_key(batches, 1):
            group = list(group)
            ids = [r[1] for r in group]
            m = np.frombuffer(b"".join(r[2] for r in group), ">u4").reshape(len(group), -1)
            parent = list(range(len(ids)))
            for i in range(len(ids) - 1):
                for j in np.flatnonzero((m[i + 1 :] == m[i]).mean(1) >= LEAST_AGREEMENT) + i + 1:
                    a, b = _find(parent, i), _find(parent, int(j))
                    if a != b:
                        parent[b] = a
            sets: dict[int, set[int]] = {}
            for i, k in enumerate(ids):
                sets.setdefault(_find(parent, i), set()).add(k)
            for s in sets.values():
                if len(s) > 1:
                    members = sorted(s)
                    yield xxhash.xxh3_64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63), members

    ordered = rows.repartition("region").sortWithinPartitions("region")
    return map_rows(ordered, run, fields(("region", "bigint"), ("members", "array<bigint>"))).dropDuplicates(["region"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted arrays without repeats."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sets(docs: DataFrame, groups: DataFrame, classes: DataFrame, most: int | None = None) -> DataFrame:
    """region, doc_id, k1 and shingles of the representative of each class in each group (region, members). A text that many rows of one doc_id have is sent once by each task."""
    wanted = groups.select("region", F.explode("members").alias("k1")).join(classes.select("k1", "k2", "rep"), "k1")
    wanted = stage(wanted.groupBy("rep", "k1", "k2").agg(F.collect_set("region").alias("regions")), "near", most)
    small = wanted.count() <= BROADCAST_ROWS
    found = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "k1", "k2", "regions", "text")

    def sets(batches):
        table, sent = WordHashes(), set()
        for rows in batches:
            for doc_id, k1, k2, regions, text in rows:
                if (k1, k2) in sent:
                    continue
                s = shingles(text, table)
                if _keys(s) == (k1, k2):
                    sent.add((k1, k2))
                    data = s.tobytes()
                    for r in regions:
                        yield r, doc_id, k1, data

    return map_rows(found, sets, fields(("region", "bigint"), ("doc_id", "bigint"), ("k1", "bigint"), ("shingles", "binary")))


def _links(docs: DataFrame, groups: DataFrame, classes: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Confirmed links (a, b) between doc_ids that connect each group's similar documents; pairs that are already connected in a group are not compared again."""

    def confirm(batches):
        for _, group in by_key(batches, 1):
            # Several tasks may have sent a class.
            group = [next(same) for _, same in itertools.groupby(group, key=lambda r: r[3])]
            arrays = [np.frombuffer(r[2], np.uint64) for r in group]
            parent = list(range(len(group)))
            for i in range(len(group)):
                for j in range(i + 1, len(group)):
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b and similar(arrays[i], arrays[j], percent):
                        parent[max(a, b)] = min(a, b)
                        if group[i][1] != group[j][1]:
                            yield group[i][1], group[j][1]

    ordered = _sets(docs, groups, classes, most).select("region", "doc_id", "shingles", "k1").repartition("region").sortWithinPartitions("region", "k1")
    return map_rows(ordered, confirm, fields(("a", "bigint"), ("b", "bigint")))


def _apart(classes: DataFrame, crowded: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """k1, rep, component and n of the classes in crowds that the forest has left apart."""
    small = crowded.count() <= BROADCAST_ROWS
    heads = _heads(classes).select("crowd", "k1")
    named = classes.select("k1", "rep", F.col("n_shingles").alias("n")).join(found, "rep", "left").select("k1", "rep", F.coalesce("component", "rep").alias("component"), "n")
    member = heads.join(F.broadcast(crowded.select("crowd")) if small else crowded.select("crowd"), "crowd").join(named, "k1")
    member = stage(member, "near", TREES * most)
    apart = member.groupBy("crowd").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("crowd")
    return stage(member.join(F.broadcast(apart) if small else apart, "crowd", "left_semi").select("k1", "rep", "component", "n").distinct(), "near", most)


def _spread(sets: DataFrame) -> DataFrame:
    """The shingles of sets (column shingles), one a row."""

    def run(batches):
        for b in batches:
            for part in slices(b, BATCH_BYTES, ROWS):
                whole = b"".join(x.as_buffer().to_pybytes() for x in part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(whole, np.int64))], names=["shingle"])

    return sets.select("shingles").mapInArrow(run, fields(("shingle", "bigint")))


def _common(sets: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, MOST_COMMON at most, sorted, and their numbers of sets. They only put shingles in order, so any number of them is right."""
    counts = stage(_spread(sets).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > REGION).withColumn("level", F.floor(F.log2("n")).cast("int")), "near", most)
    total, least = 0, 64
    for level, n in sorted(counts.groupBy("level").agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > MOST_COMMON:
            break
        least = level
    got = counts.where(F.col("level") >= least).select("shingle", "n").toArrow().sort_by("shingle")
    drop_stage(counts)
    return got["shingle"].to_numpy(), got["n"].to_numpy()


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Of a set of n shingles in order, how many of the first can hold the first one in common with a set as large or larger, and with any set. The first is shorter: larger sets have more in common."""
    same = -(-2 * percent * n // (100 + percent))
    return n - same + 1, n - -(-percent * n // 100) + 1


def _postings(sets: DataFrame, apart: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """shingle, place, first (whether sets as large or larger may have it in common first), often (whether it is a common one), k1, component and n: the first shingles of each set, the rarest first."""
    spark = sets.sparkSession
    shared = spark.sparkContext.broadcast(common)
    rows = sets.join(apart.select("k1", "component"), "k1").select("k1", "component", "shingles")
    schema = fields(("shingle", "bigint"), ("place", "int"), ("first", "boolean"), ("often", "boolean"), ("k1", "bigint"), ("component", "bigint"), ("n", "int"))

    def run(batches):
        known, counts = shared.value
        for b in batches:
            for part in slices(b, BATCH_BYTES, ROWS):
                out = []
                for k1, component, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    s = np.frombuffer(data, np.int64)
                    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                    often = np.where(known[at] == s, counts[at], 0) if len(known) else np.zeros(len(s), np.int64)
                    short, long_ = prefix_lengths(len(s), percent)
                    order = np.lexsort((s, often))[:long_]
                    place = np.arange(len(order), dtype=np.int32)
                    same = lambda v, kind, n=len(order): np.full(n, v, kind)
                    out.append((s[order], place, place < short, often[order] > 0, same(k1, np.int64), same(component, np.int64), same(len(s), np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _pairs(postings: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Groups of two: classes of different components whose rare first shingles meet where enough of both sets is left, and whose signatures agree enough."""
    rare = postings.where("not often")
    a = rare.where("first").select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("k1", "component", "n", "place")])
    b = rare.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("k1", "component", "n", "place")])
    left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")).cast("long")
    fits = (F.col("a_n") <= F.col("b_n")) & (100 * F.col("a_n").cast("long") >= percent * F.col("b_n")) & (left * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n")))
    met = a.join(b, "shingle").where((F.col("a_component") != F.col("b_component")) & fits).select(F.least("a_k1", "b_k1").alias("a"), F.greatest("a_k1", "b_k1").alias("b")).distinct()
    sig = lambda name: classes.select(F.col("k1").alias(name), F.col("sig").alias(f"sig_{name}"))
    signed = met.join(sig("a"), "a").join(sig("b"), "b")

    def agree(batches):
        for rows in batches:
            x, y = (np.frombuffer(b"".join(r[i] for r in rows), np.uint32).reshape(len(rows), -1) for i in (2, 3))
            for i in np.flatnonzero((x == y).mean(1) >= LEAST_AGREEMENT).tolist():
                members = [rows[i][0], rows[i][1]]
                yield xxhash.xxh3_64_intdigest(np.array(members, np.int64).tobytes()) - (1 << 63), members

    return map_rows(signed.select("a", "b", "sig_a", "sig_b"), agree, fields(("region", "bigint"), ("members", "array<bigint>")))


def _cells(postings: DataFrame, percent: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks of the classes (k1, component, n, block) that common first shingles bring together, each class in one; and pairs of blocks (left, right) that have such a shingle in common, and classes of different components.

    A component that fills blocks has its own; the others are pooled. Blocks are by hash, so that no task sees all of a shingle's classes.
    """
    member = postings.where("often").select(F.col("shingle").alias("crowd"), "k1", "component", "n", "first")
    apart = member.groupBy("crowd").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("first").alias("z")).where("x < y and z").select("crowd")
    rows = postings.count()
    member = stage(member.join(apart, "crowd", "left_semi").select("crowd", "k1", "component", "n"), "near", rows)
    homes = member.groupBy("k1", "component", "n").agg(F.min("crowd").alias("crowd"))
    cost = F.greatest(F.col("n").cast("long"), F.lit(BLOCK_SHINGLES // BLOCK))
    sizes = homes.groupBy("crowd", "component").agg(F.sum(cost).alias("cost"))
    sizes = stage(sizes.withColumn("own", F.col("cost") * 2 > BLOCK_SHINGLES), "near", most)
    pools = sizes.where("not own").groupBy("crowd").agg(F.ceil(F.sum("cost") / BLOCK_SHINGLES).alias("pools"))
    placed = homes.join(sizes, ["crowd", "component"]).join(pools, "crowd", "left")
    own = F.xxhash64("crowd", "component", F.pmod(F.xxhash64("k1"), F.ceil(F.col("cost") / BLOCK_SHINGLES)))
    block = F.when(F.col("own"), own).otherwise(F.xxhash64("crowd", F.lit("pool"), F.pmod(F.xxhash64("component"), F.coalesce("pools", F.lit(1)))))
    blocks = stage(placed.select("k1", "component", "n", block.alias("block")), "near", most)
    of = blocks.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    side = lambda name: of.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "least", "most")])
    met = stage(member.join(blocks.select("k1", "block"), "k1").select("crowd", "block").distinct(), "near", rows)
    cells = met.select("crowd", F.col("block").alias("left")).join(met.select("crowd", F.col("block").alias("right")), "crowd").where("left <= right").select("left", "right").distinct()
    cells = cells.join(side("left"), "left").join(side("right"), "right").where("least(left_low, right_low) < greatest(left_high, right_high)")
    cells = cells.where(f"100 * left_most >= {percent} * right_least and 100 * right_most >= {percent} * left_least")
    return blocks, stage(cells.select("left", "right"), "near")


def _crowd_links(docs: DataFrame, crowded: DataFrame, classes: DataFrame, found: DataFrame, percent: int, most: int) -> DataFrame:
    """Confirmed links (a, b) in crowds between documents of different components.

    Shingles are put in order, the common ones last. Two sets that are similar
    have one in common among their first few, and so much left behind it as
    they need. Where that one is rare, its few classes are candidates. Where
    it is common, nearly all of a set is, so its classes are mostly one
    component already; those that aren't are compared in blocks.
    """
    apart = _apart(classes, crowded, found, most)
    if apart.isEmpty():
        return found.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    alone = apart.select(F.col("k1").alias("region"), F.array("k1").alias("members"))
    sets = stage(_sets(docs, alone, classes, most).select("k1", "shingles").dropDuplicates(["k1"]), "near")
    total = apart.agg(F.sum("n")).first()[0]
    postings = stage(_postings(sets, apart, _common(sets, total // REGION), percent), "near")
    drop_stage(sets)
    links = _links(docs, stage(_pairs(postings, classes, percent), "near"), classes, percent, most)
    return links.unionByName(_common_links(docs, postings, classes, percent, most))


def _common_links(docs: DataFrame, postings: DataFrame, classes: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Confirmed links (a, b) between documents of different components whose first shingle in common is a common one: in pairs of blocks by signatures, then on full sets."""
    blocks, cells = _cells(postings, percent, most)
    rows = blocks.join(classes.select("k1", "sig"), "k1")
    sides = cells.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    rows = sides.join(rows, "block").select("left", "right", "block", "k1", "component", "n", "sig")

    def compare(batches):
        for (left, right), group in by_key(batches, 2):
            group = list(group)
            at = [np.array([i for i, r in enumerate(group) if r[2] == b]) for b in (left, right)]
            k, c, n = (np.array([r[x] for r in group], np.int64) for x in (3, 4, 5))
            m = np.frombuffer(b"".join(r[6] for r in group), ">u4").astype(np.uint32).reshape(len(group), -1)
            others = at[1]
            mo, co, no = m[others], c[others], n[others]
            cell = xxhash.xxh3_64_intdigest(np.array([left, right], np.int64).tobytes()) - (1 << 63)
            paired = np.zeros(len(group), bool)
            for x, i in enumerate(at[0]):
                first = x + 1 if left == right else 0
                fits = (co[first:] != c[i]) & (100 * np.minimum(no[first:], n[i]) >= percent * np.maximum(no[first:], n[i]))
                js = np.flatnonzero(fits) + first
                if len(js):
                    js = js[(mo[js] == m[i]).mean(1) >= LEAST_AGREEMENT]
                    if len(js):
                        paired[i] = True
                        paired[others[js]] = True
                        yield cell, int(k[i]), k[others[js]].tolist()
            if paired.any():
                yield cell, None, k[paired].tolist()

    ordered = rows.repartition("left", "right").sortWithinPartitions("left", "right")
    pairs = stage(map_rows(ordered, compare, fields(("region", "bigint"), ("k1", "bigint"), ("others", "array<bigint>"))), "near")
    # A row without k1 lists all classes of a cell's pairs.
    sets = _sets(docs, pairs.where("k1 is null").select("region", F.col("others").alias("members")), classes, most)

    def confirm(batches):
        for _, group in by_key(batches, 1):
            ids: dict[int, int] = {}
            docs_, arrays, parent, starts = [], [], [], None
            # Sets come before pairs.
            for _, _, k1, doc_id, data, others in group:
                if others is None:
                    if k1 in ids:
                        continue
                    ids[k1] = len(arrays)
                    parent.append(len(arrays))
                    docs_.append(doc_id)
                    arrays.append(np.frombuffer(data, np.uint64))
                    continue
                if starts is None:
                    sizes = np.array([len(s) for s in arrays])
                    starts = np.cumsum(sizes) - sizes
                    terms = np.unique(np.concatenate(arrays), return_inverse=True)[1].astype(np.int32)
                    mark = np.zeros(int(terms.max()) + 1, np.uint8)
                i, js = ids[k1], [ids[o] for o in others]
                if 8 * len(js) >= len(arrays):
                    mine = terms[starts[i] : starts[i] + sizes[i]]
                    mark[mine] = 1
                    common = np.add.reduceat(mark[terms], starts, dtype=np.int64)
                    mark[mine] = 0
                    alike = 100 * common >= percent * (sizes + sizes[i] - common)
                    js = [j for j in js if alike[j]]
                else:
                    js = [j for j in js if similar(arrays[i], arrays[j], percent)]
                for j in js:
                    x, y = _find(parent, i), _find(parent, j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        if docs_[i] != docs_[j]:
                            yield docs_[i], docs_[j]

    none = lambda kind: F.lit(None).cast(kind)
    sets = sets.select("region", F.lit(0).alias("step"), "k1", "doc_id", "shingles", none("array<bigint>").alias("others"))
    both = sets.unionByName(pairs.where("k1 is not null").select("region", F.lit(1).alias("step"), "k1", none("bigint").alias("doc_id"), none("binary").alias("shingles"), "others"))
    return map_rows(both.repartition("region").sortWithinPartitions("region", "step"), confirm, fields(("a", "bigint"), ("b", "bigint")))


def _sharing(docs: DataFrame, classes: DataFrame, percent: int, most: int) -> DataFrame:
    """Groups of two for all pairs of classes that can be similar, without chance.

    A class's shingles are put in order from the rarest on; two sets that are
    similar enough have one in common among the first n - ceil(n * percent / 100) + 1
    of each. Shingles that all share come last and make no pairs.
    """
    alone = classes.select(F.col("k1").alias("region"), F.array("k1").alias("members"))

    def each(batches):
        for rows in batches:
            for k1, data in rows:
                s = np.frombuffer(data, np.int64)
                for x in s.tolist():
                    yield k1, len(s), x

    spread = map_rows(_sets(docs, alone, classes, most).dropDuplicates(["k1"]).select("k1", "shingles"), each, fields(("k1", "bigint"), ("n", "bigint"), ("shingle", "bigint")), 65_536)
    spread = stage(spread, "near")
    shared = spread.groupBy("shingle").agg(F.count("*").alias("rows_"))
    place = F.row_number().over(Window.partitionBy("k1").orderBy("rows_", "shingle"))
    first = spread.join(shared, "shingle").withColumn("place", place)
    first = stage(first.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("rows_") > 1)).select("shingle", "k1", "n"), "near")
    a, b = first.alias("a"), first.alias("b")
    fits = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.k1") < F.col("b.k1")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    pairs = a.join(b, fits).select(F.array("a.k1", "b.k1").alias("members")).distinct()
    return stage(pairs.select(F.xxhash64("members").alias("region"), "members"), "near")


def near_duplicates(docs: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """Groups of documents that links of at least percent similarity connect.

    Candidates come from the forest, so a link may be missed by chance; with
    exact, all pairs that share a rare enough shingle are candidates instead,
    which misses none and costs a shuffle of all shingles.

    docs: doc_id (long), text. Returns doc_id, n_shingles, component_id
    (smallest doc_id of the group), kept (whether it is that one), one row per
    input row. Null and empty texts have no shingles and stay alone. Rows
    with the same doc_id are one document to links, whatever their texts. A
    null doc_id has a null component_id, and kept is true.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(_signed(docs), "near")
    some = signed.where("k1 is not null and doc_id is not null")
    classes = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("x"), F.count("*").alias("rows_")).select("k1", "k2", F.col("x.doc_id").alias("rep"), F.col("x.sig").alias("sig"), F.col("x.n_shingles").alias("n_shingles"), "rows_")
    # Classes are no more than rows, which bounds most tables below.
    most = signed.count()
    classes = stage(classes, "near", most)
    if exact:
        groups = _sharing(docs, classes, percent, most)
    else:
        crowded = _crowded(classes, most)
        regions = stage(_regions(classes, crowded), "near", TREES * most)
        release(spark)
        groups = stage(_narrowed(regions, classes), "near", TREES * most)
        drop_stage(regions)
    links = _links(docs, groups, classes, percent, most)
    # Rows that share a doc_id connect the classes of their texts.
    own = some.select("doc_id", "k1", "k2").join(classes.where("rows_ > 1").select("k1", "k2", "rep"), ["k1", "k2"])
    repeated = some.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = own.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stage(links.unionByName(again), "near")
    release(spark)
    found = components(links, most=links.count()).select(F.col("node").alias("rep"), "component").distinct()
    if not exact and not crowded.isEmpty():
        more = stage(_crowd_links(docs, crowded, classes, found, percent, most), "near")
        release(spark)
        if not more.isEmpty():
            found = components(links.unionByName(more), most=links.count() + more.count()).select(F.col("node").alias("rep"), "component").distinct()
    member = signed.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(found, "rep", "left")
    # A repeated doc_id may also be reached by another of its rows.
    component = F.coalesce("component", "rep", "doc_id")
    out = member.select("doc_id", "n_shingles", component.alias("component_id"))
    if not repeated.isEmpty():
        least = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(least, "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

