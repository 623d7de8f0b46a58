"""Exact top-k search by a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it, and stored in
blocks that are annuli around a pivot. A query starts at the annulus nearest
to its own distance and expands outwards and inwards; the triangle inequality
bounds every score from an annulus on, so it stops where nothing beyond can
reach its k-th best score. Scores are integer inner products, so
2 q.v = |q|^2 + |v|^2 - |q - v|^2 turns a least distance into a highest score.

Components are whole numbers, kept as doubles. Products of vectors shorter
than 2^26 are exact in these; longer vectors are in blocks of their own and
are multiplied as Python's integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, fields, map_rows, release, stage

PIVOTS = 64
#: Vectors among which the pivots are chosen: those with the smallest hashes of their ids.
PIVOT_SAMPLE = 2048
BLOCK = 512
#: Queries that every task holds at a time; more are searched in rounds.
ROUND = 32_768
#: Vectors of this length and more are multiplied as integers of any size.
LONG = float(1 << 26)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NOBODY = np.iinfo(np.int64).max


def integer_vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, a whole number as double; rows with a null id or vector, or with null or non-finite components (before or after scaling), are left out. Of an id's several vectors the smallest stays."""
    x = F.transform(F.col(column), lambda c: c.cast("double") * float(scale))
    good = F.col(key).isNotNull() & F.col(column).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor() gives longs, which huge components don't fit; those are whole numbers as they are.
    v = F.transform(x, lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c))
    return table.where(good).select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample's vector that is farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(rows: list[list[float]], width: int) -> np.ndarray:
    """Rows as doubles, filled up with zeros to width."""
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _from_arrow(lists, width: int) -> np.ndarray:
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.values, np.float64)
    return flat.reshape(-1, width) if len(lengths) and (lengths == width).all() else _matrix(lists.to_pylist(), width)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * m @ pivots.T, 0))


def build_index(vectors: DataFrame, width: int, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """One row per annulus: pivot, near, far (radii), norm (largest squared norm), ids and data (doubles). Pivot -1 has the long vectors.

    Range partitions by pivot, distance and id: a cell that holds a third of
    all vectors, or a vector that is repeated under many ids, is cut into as
    many annuli as its rows need.
    """
    keyed = fields(("pivot", "int"), ("distance", "double"), ("vec_id", "bigint"), ("data", "binary"))

    def key(batches):
        for rows in batches:
            m = _matrix([v for _, v in rows], width)
            long_ = ~(_norms(m) < LONG)
            d = _distances(np.where(long_[:, None], 0, m), pivots)
            near = d.argmin(1)
            for j, (vec_id, _) in enumerate(rows):
                at, far = (-1, 0.0) if long_[j] else (int(near[j]), float(d[j, near[j]]))
                yield at, far, vec_id, m[j].tobytes()

    def pack(batches):
        held: list[tuple] = []
        for rows in batches:
            for r in rows:
                if held and (r[0] != held[0][0] or len(held) >= block):
                    yield annulus(held)
                    held = []
                held.append(r)
        if held:
            yield annulus(held)

    def annulus(rows):
        data = b"".join(r[3] for r in rows)
        most = float((np.frombuffer(data).reshape(len(rows), width) ** 2).sum(1).max()) if rows[0][0] >= 0 else 0.0
        return rows[0][0], rows[0][1], rows[-1][1], most, np.array([r[2] for r in rows], np.int64).tobytes(), data

    rows = map_rows(vectors, key, keyed).repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return map_rows(rows, pack, fields(("pivot", "int"), ("near", "double"), ("far", "double"), ("norm", "double"), ("ids", "binary"), ("data", "binary")), 64)


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m**2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of whole numbers of any size; beyond a long's range, its ends."""
    x, y = ([[int(c) for c in row] for row in m.tolist()] for m in (a, b))
    return np.array([[min(max(sum(p * q for p, q in zip(r, c, strict=True)), _LEAST + 1), _MOST) for c in y] for r in x], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, smaller id first) of each query so far. A place that isn't taken has the least score and the largest id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), _LEAST, np.int64)
        self.ids = np.full((n, k), _NOBODY)
        self.floor = np.full(n, _LEAST, np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the queries which with the vectors ids; the least long stands for no score."""
        if scores.shape[1] > 4 * self.k:
            # All that tie with the k-th best stay until ids decide.
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            some = (scores >= np.maximum(kth, self.least()[which])[:, None]).any(0)
            scores, ids = scores[:, some], ids[some]
        i = np.where(scores == _LEAST, _NOBODY, ids[None])
        s = np.concatenate([self.scores[which], scores], 1)
        i = np.concatenate([self.ids[which], i], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]
        self.scores[which], self.ids[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def bounds(q_norm: np.ndarray, to_pivot: np.ndarray, q_dot_pivot: np.ndarray, near: np.ndarray | float, far: np.ndarray | float, norm: np.ndarray | float) -> np.ndarray:
    """Highest score that a vector with a distance from near to far, and a squared norm up to norm, can have with each query. Both the triangle inequality and q.v = q.p + q.(v - p) give one."""
    gap = np.maximum(np.maximum(near - to_pivot, to_pivot - far), 0)
    by_distance = (q_norm**2 + norm - gap**2) / 2
    by_angle = q_dot_pivot + q_norm * far
    top = np.minimum(by_distance, by_angle)
    return top + 1e-6 * (1 + np.abs(top))


class Round:
    """A bounded number of queries and their best so far."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, points: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.ids, self.m, self.best = ids, m, Best(len(ids), k)
        self.best.floor = floor
        self.norm = _norms(m)
        self.long = ~(self.norm < LONG)
        short = np.where(self.long[:, None], 0, m)
        self.to_pivot, self.dots = _distances(short, points), short @ points.T

    def visit(self, which: np.ndarray, ids: bytes, data: bytes, exact: bool) -> None:
        v_ids = np.frombuffer(ids, np.int64)
        v = np.frombuffer(data).reshape(len(v_ids), -1)
        scores = products(self.m[which], v) if exact else (self.m[which] @ v.T).astype(np.int64)
        scores[self.ids[which][:, None] == v_ids[None]] = _LEAST
        self.best.add(which, scores, v_ids)

    def expand(self, pivot: int, annuli: list[tuple]) -> None:
        """Visits the annuli of a pivot, rising in distance: each query its nearest one first, then on both sides until nothing from there on can count."""
        near, far, norm = (np.array([a[i] for a in annuli]) for i in range(3))
        to, dot = self.to_pivot[:, pivot], self.dots[:, pivot]
        most_up, most_down = np.maximum.accumulate(norm[::-1])[::-1], np.maximum.accumulate(norm)
        start = np.searchsorted(far, to)
        for step, first in ((1, start), (-1, start - 1)):
            at = first.copy()
            live = np.flatnonzero(~self.long & (at >= 0) & (at < len(annuli)))
            while len(live):
                i = at[live]
                q, d, p, least = self.norm[live], to[live], dot[live], self.best.least()[live]
                rest = bounds(q, d, p, near[i], far[-1], most_up[i]) if step > 0 else bounds(q, d, p, near[0], far[i], most_down[i])
                goes = rest >= least
                live, i = live[goes], i[goes]
                q, d, p, least = q[goes], d[goes], p[goes], least[goes]
                counts = bounds(q, d, p, near[i], far[i], norm[i]) >= least
                for a in np.unique(i[counts]).tolist():
                    self.visit(live[counts & (i == a)], annuli[a][3], annuli[a][4], False)
                at[live] += step
                live = live[(at[live] >= 0) & (at[live] < len(annuli))]

    def search(self, blocks: list[tuple]) -> None:
        """blocks: rows of the index."""
        pivots: dict[int, list[tuple]] = {}
        for p, *annulus in blocks:
            pivots.setdefault(p, []).append(tuple(annulus))
        every, long_ = np.arange(len(self.ids)), np.flatnonzero(self.long)
        # Queries whose pivots are nearest come to high scores soonest.
        for p in sorted(pivots, key=lambda p: float(self.to_pivot[:, p].sum()) if p >= 0 else -1.0):
            for _, _, _, ids, data in pivots[p] if p < 0 or len(long_) else ():
                self.visit(every if p < 0 else long_, ids, data, True)
            if p >= 0:
                self.expand(p, sorted(pivots[p], key=lambda a: (a[0], a[1])))


def _searcher(ids: np.ndarray, m: np.ndarray, points: np.ndarray, k: int, floor: np.ndarray):
    def run(batches):
        round_ = Round(ids, m, points, k, floor)
        for rows in batches:
            round_.search(rows)
        best = round_.best
        for q, least, s, i in zip(ids.tolist(), best.least().tolist(), best.scores.tolist(), best.ids.tolist(), strict=True):
            for x, y in zip(s, i, strict=True):
                if y != _NOBODY and x >= least:
                    yield q, y, x

    return run


def _floor(ids: np.ndarray, m: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score in the sample, which its k-th best of all reaches at least."""
    out = np.full(len(ids), _LEAST, np.int64)
    short = np.flatnonzero(_norms(m) < LONG)
    known = np.flatnonzero(_norms(sample) < LONG)
    if len(known) > k:
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            scores = (m[part] @ sample[known].T).astype(np.int64)
            scores[ids[part][:, None] == sample_ids[known][None]] = _LEAST
            out[part] = np.partition(scores, len(known) - k, axis=1)[:, -k]
    return out


def search(vectors: DataFrame, queries: Column, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, round_: int = ROUND) -> DataFrame:
    """The k highest inner products of each query with the vectors of other ids, ties to smaller ids.

    vectors: (vec_id, v) as integer_vectors() gives; queries: a condition on
    vec_id. Returns query_id, rank (from 1), vec_id, score. Shorter vectors
    count as filled up with zeros. Products are exact; one that a long can't
    hold counts as the nearest long. An empty table, or one vector, has no
    rows.

    Queries are searched in rounds; a round's are on the driver and in every
    task, and its result is a table before the next begins. A task goes
    through its share of the index and gives at most k rows a query, all of
    which reach the k-th best score of a sample.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0] or 1
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    sample_ids, known = np.array([r.vec_id for r in sample], np.int64), _matrix([r.v for r in sample], width)
    points = choose_pivots(known[_norms(known) < LONG], pivots)
    if not len(points):
        points = np.zeros((1, width))
    index = stage(build_index(vectors, width, points, block), "index")
    release(spark)
    asked = vectors.where(queries)
    rounds = max(1, -(-asked.count() // round_))
    schema = fields(("query_id", "bigint"), ("vec_id", "bigint"), ("score", "bigint"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = spark.createDataFrame([], fields(("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")))
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).select("vec_id", "v").toArrow()
        if len(part):
            ids, m = np.asarray(part["vec_id"], np.int64), _from_arrow(part["v"].combine_chunks(), width)
            found = map_rows(index, _searcher(ids, m, points, k, _floor(ids, m, sample_ids, known, k)), schema)
            found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            out = out.unionByName(stage(found, "found"))
    drop_stage(index)
    drop_stage(vectors)
    return out
