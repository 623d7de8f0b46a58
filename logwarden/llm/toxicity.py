"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words, in lower case and without outer
punctuation, hashed to buckets. The score is the logistic of a bias, a weight
for each term, and the inner products of the vectors of each pair of its
terms: so that words which are harmless alone can count together. Training
first fits the weights with an L1 penalty, which leaves few terms. Then all
pairs of terms are tested for what the weights miss: terms of pairs that occur
with the label more often, or less, than the fit expects are taken in as well,
however harmless they are alone. Vectors are learned for the terms of both
kinds, and scoring reads no others.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fields, map_rows

BUCKETS = 1 << 18
FACTORS = 8
#: Most labelled rows that are used for fitting: those with the smallest hashes of their ids.
TRAIN_ROWS = 8_000
#: Rows with the label that a term needs for its pairs to be tested.
PAIR_ROWS = 8
#: Deviations from what the weights expect from which a pair's terms get vectors; chance gives about one pair in 10^9.
PAIR_DEVIATIONS = 6.0
_OUTER = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CACHE = 1 << 18


class Terms(dict):
    """UTF-8 word -> its bucket, or -1 if no letter or digit is left, or if it isn't among the kept buckets."""

    def __init__(self, kept: set[int] | None = None) -> None:
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> int:
        term = word.strip(_OUTER).decode().lower()
        b = zlib.crc32(term.encode()) % BUCKETS if term else -1
        if self.kept is not None and b not in self.kept:
            b = -1
        if len(word) <= 64:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = b
        return b

    def of(self, text: str | None) -> set[int]:
        out = set(map(self.__getitem__, set((text or "").encode().split())))
        out.discard(-1)
        return out


@dataclass
class Machine:
    """bias + sum of weights + inner products of vectors over all pairs of a document's terms."""

    bias: float
    weights: dict[int, float]
    vectors: dict[int, np.ndarray]

    def score(self, terms: set[int]) -> float:
        z, total, squares = self.bias, np.zeros(FACTORS), 0.0
        for t in sorted(terms & self.weights.keys()):
            z += self.weights[t]
            v = self.vectors[t]
            total += v
            squares += float(v @ v)
        z += 0.5 * (float(total @ total) - squares)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pair_terms(f: np.ndarray, owner: np.ndarray, d: int, y: np.ndarray, p: np.ndarray, pair_rows: int = PAIR_ROWS) -> np.ndarray:
    """Terms of the pairs whose common rows have the label significantly more or less often than p says.

    f, owner: the term and row of each occurrence, of d terms. For each pair,
    what is expected but missing, and what is there but unexpected, are sums
    over its common rows, made for blocks of terms by products of matrices.
    """
    some = np.flatnonzero(np.bincount(f[y[owner] > 0], minlength=d) >= pair_rows)
    place = np.full(d, -1, np.int32)
    place[some] = np.arange(len(some))
    n, m, block, part_rows = len(y), len(some), 256, 512
    dense = np.zeros((n, m), np.uint8)
    inside = place[f] >= 0
    dense[owner[inside], place[f[inside]]] = 1
    found = np.zeros(m, bool)
    labelled = [(np.flatnonzero(y > 0), 1 - p), (np.flatnonzero(y == 0), p)]
    for i in range(0, m, block):
        sums = np.zeros((2, m, min(block, m - i)), np.float32)
        for k, (rows, weight) in enumerate(labelled):
            for j in range(0, len(rows), part_rows):
                some_rows = rows[j : j + part_rows]
                part = dense[some_rows].astype(np.float32)
                sums[k] += part.T @ (part[:, i : i + block] * weight[some_rows, None].astype(np.float32))
        # Under the fit both sums have the same mean, and their difference about that variance.
        far = np.abs(sums[0] - sums[1]) >= PAIR_DEVIATIONS * np.sqrt((sums[0] + sums[1]) / 2 + 0.5)
        far[np.arange(i, i + far.shape[1]), np.arange(far.shape[1])] = False
        found |= far.any(1)
    return some[found]


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 30, lasso: float | None = None, ridge: float = 1e-3, seed: int = 5, term_rows: int = 3, pair_rows: int = PAIR_ROWS) -> Machine:
    """A machine from the distinct terms of each row and its label. Full-batch proximal gradient for the weights, then gradient steps for weights and vectors of the terms left and of those that pair_terms() finds. The default lasso falls with the root of the number of rows, as chance correlations do. Terms of fewer than term_rows rows, and pairs of terms that either has fewer than pair_rows rows with the label, are chance and left out; 1 and 1 leave out none."""
    n = len(rows)
    lasso = 0.055 / max(n, 1) ** 0.5 if lasso is None else lasso
    if not n or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (n + 1) if n else 0.0
        return Machine(float(np.log(share / (1 - share))) if n else -30.0, {}, {})
    flat = np.concatenate(rows).astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=BUCKETS)
    used = np.flatnonzero(seen >= min(term_rows, max(1, n // 50)))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    f = place[flat]
    del flat
    keep = f >= 0
    f, owner = f[keep], owner[keep]
    d = len(used)
    y = labels.astype(float)
    prior = y.mean()
    bias, w = float(np.log(prior / (1 - prior))), np.zeros(d)
    # Each weight has its own step, by how much its column can bend the loss.
    bend = np.maximum(np.bincount(f, minlength=d), 1) * 0.25 / n
    size = np.bincount(owner, minlength=n)
    step = 4.0 / (bend * np.minimum(np.maximum(np.median(size), 1), 40)) * 0.5
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(rounds * 4):
        g = (chance(bias + np.bincount(owner, w[f], n)) - y) / n
        grad = np.bincount(f, g[owner], d)
        w = w - step * grad * 0.25
        w = np.sign(w) * np.maximum(np.abs(w) - step * 0.25 * lasso, 0)
        bias -= g.sum()
    left = np.union1d(np.flatnonzero(w), pair_terms(f, owner, d, y, chance(bias + np.bincount(owner, w[f], n)), pair_rows))
    if not len(left):
        return Machine(bias, {}, {})
    inside = np.full(d, -1, np.int32)
    inside[left] = np.arange(len(left))
    keep = inside[f] >= 0
    f, owner, m = inside[f[keep]], owner[keep], len(left)
    w = w[left]
    v = np.random.default_rng(seed).normal(0, 0.05, (m, FACTORS))
    hw, hv, hb = np.full(m, 1e-6), np.full((m, FACTORS), 1e-6), 1e-6
    for _ in range(rounds * 5):
        sums = np.stack([np.bincount(owner, v[f, k], n) for k in range(FACTORS)], 1)
        pairs = 0.5 * ((sums**2).sum(1) - np.bincount(owner, (v[f] ** 2).sum(1), n))
        g = (chance(bias + np.bincount(owner, w[f], n) + pairs) - y) / n
        gw = np.bincount(f, g[owner], m) + ridge * w / n
        each = g[owner, None] * (sums[owner] - v[f])
        gv = np.stack([np.bincount(f, each[:, k], m) for k in range(FACTORS)], 1) + ridge * v
        hw, hv, hb = hw + gw**2, hv + gv**2, hb + g.sum() ** 2
        w, v, bias = w - 0.3 * gw / np.sqrt(hw), v - 0.05 * gv / np.sqrt(hv), bias - 0.1 * g.sum() / np.sqrt(hb)
    names = used[left].tolist()
    return Machine(float(bias), dict(zip(names, w.tolist(), strict=True)), dict(zip(names, v, strict=True)))


def held_out(doc_id):
    """crc32(doc_id as text) mod 4 is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, **options) -> Machine:
    """options are those of fit(). Fits on at most rows labelled documents, none of them held out. A doc_id with several labels has the largest; null labels take no part. Of several documents with one doc_id, that with the least hash of its text is used."""
    some = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("y_")).where("doc_id is not null and y_ is not null").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("y_").cast("int").alias("y_")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The limit bounds the broadcast side.
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.xxhash64("text").alias("text_"), "y_", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = fields(("doc_id", kind), ("text_", "bigint"), ("y", "int"), ("terms", "binary"))

    def terms(batches):
        table = Terms()
        for batch in batches:
            for doc_id, h, y, text in batch:
                yield doc_id, h, y, np.array(sorted(table.of(text)), np.int32).tobytes()

    one = map_rows(found, terms, schema).groupBy("doc_id").agg(F.min_by(F.struct("y", "terms"), "text_").alias("x"))
    got = one.select("doc_id", "x.y", "x.terms").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(t.as_buffer(), np.int32) for t in got["terms"]], got["y"].to_numpy().astype(np.int8), **options)


def score_documents(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; null and empty texts get the machine's bias. One pass without a shuffle."""
    schema = fields(("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("held_out", "boolean"), ("score", "double"), ("predicted", "int"))

    def run(batches):
        table = Terms(set(machine.weights))
        for rows in batches:
            for doc_id, out, text in rows:
                s = machine.score(table.of(text))
                yield doc_id, out, s, int(s >= threshold)

    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, schema)


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that score below threshold."""
    at, names = docs.columns.index("text"), docs.columns
    plain = docs.toDF(*[f"in{i}_" for i in range(len(names))])
    column = plain.columns[at]

    def run(batches):
        table = Terms(set(machine.weights))
        for b in by_bytes(batches, column):
            keep = [machine.score(table.of(t)) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
