"""Substring dedup by fixed-block anchors.

Words covered by a passage of at least W words that occurs again are removed.
With blocks of B = (W + 1) // 2 words, each window of W words holds a whole
block of its document's grid. So every repeated window holds an indexed block
whose B words also start somewhere else. First, the blocks are the index,
and every rolling window of B words probes it. Then only windows of W
words around hit blocks are compared, by 96 bits of hash, and the repeats are
joined to maximal ranges.

What is sent is packed: a row holds a chunk's sorted probes for one range of
hashes, four bytes a probe, each value once a chunk. Windows are sent in runs
that share their least block hash, so replies are runs too. Of windows that
are equal within a chunk one is sent, and all are known to be repeats there:
so a passage that a third of all documents share is as long in a chunk as it
is itself.

A chunk sends a bounded number of rows, whatever the number of buckets: where
there are more buckets than that, rows of a coarse bucket are put together to
chunks again and dealt to finer ones, as a radix sort does, so that work is
linear in the input times the number of rounds: one up to some 15 GB, two up to petabytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, drop_stage, fields, map_rows, release, stage
from .neardup import WordHashes, mixed

WINDOW = 35
#: Words of the documents that are hashed together.
CHUNK = 1 << 20
#: Probes that one task gets at a time.
BUCKET_PROBES = 3_000_000
#: Most buckets that a chunk is dealt to at once, and most partitions of a shuffle; both are powers of two.
FAN, PARTITIONS = 1 << 10, 1 << 16
_BITS = np.uint64(48)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASES)


def rolling(words: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of every width consecutive words: polynomial modulo 2^64 by prefix sums, then mixed."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _POWERS[lane].upto(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])])
    return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])


class Chunk:
    """Several documents' word hashes, one after another."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.parts: list[bytes] = []
        self.extra: list = []
        self.words = 0

    def add(self, key: int, hashes: bytes, extra=None) -> None:
        self.keys.append(key)
        self.parts.append(hashes)
        self.extra.append(extra)
        self.words += len(hashes) // 8

    def close(self) -> None:
        lengths = np.array([len(p) // 8 for p in self.parts])
        self.all = np.frombuffer(b"".join(self.parts), np.uint64)
        self.parts = []
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.place = np.arange(len(self.all), dtype=np.int32) - self.starts.astype(np.int32)[self.owner]
        self.left = lengths.astype(np.int32)[self.owner] - self.place
        self.ids = np.array(self.keys, np.int64)


def _chunks(batches, window: int, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of the (key, text, ...) rows that hold a window."""
    table, chunk = WordHashes(), Chunk()
    for rows in batches:
        for key, text, *extra in rows:
            h = b"".join(map(table.__getitem__, (text or "").encode().split()))
            if len(h) >= 8 * window:
                chunk.add(key, h, *extra)
                if chunk.words >= size:
                    full, chunk = chunk, Chunk()
                    full.close()
                    yield full
                    del full
    if chunk.keys:
        chunk.close()
        yield chunk


def _squeeze(sorted_: np.ndarray) -> bytes:
    """Rising numbers: the first as 8 bytes, then differences as 4 bytes each; or, after a first of all ones, 8 bytes each if a difference is too large."""
    gaps = np.diff(sorted_)
    if len(gaps) and gaps.max() >= 1 << 32:
        return b"\xff" * 8 + sorted_.tobytes()
    return sorted_[:1].tobytes() + gaps.astype(np.uint32).tobytes()


def _expand(data: bytes) -> np.ndarray:
    if data[:8] == b"\xff" * 8:
        return np.frombuffer(data, np.uint64, offset=8)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), np.frombuffer(data, np.uint32, offset=8).astype(np.uint64)]))


def _log2(n: int) -> int:
    return n.bit_length() - 1


def _dealt(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(min(partitions, PARTITIONS), "bucket").sortWithinPartitions("bucket")


def _refined(rows: DataFrame, buckets: int, again, schema) -> DataFrame:
    """rows, dealt to FAN coarse buckets at most, by buckets; again(groups of rows by bucket, bits of the finer bucket) deals one round."""
    fan = min(buckets, FAN)
    while fan < buckets:
        finer = min(buckets, fan * FAN)
        rows = map_rows(_dealt(rows, fan), lambda batches, more=_log2(finer // fan), bits=_log2(finer): again(batches, more, bits), schema, 256)
        fan = finer
    return _dealt(rows, buckets)


def _deal_probes(batches, more: int, bits: int) -> Iterator[tuple]:
    """Probes and index rows of coarse buckets, a chunk at a time, by buckets of so many more bits."""

    def probes(held: list[bytes]) -> Iterator[tuple]:
        p = np.sort(np.concatenate([_expand(x) for x in held]))
        b = (p >> np.uint64(int(_BITS) - bits)).astype(np.int64)
        for i, j in _stretches(b):
            yield int(b[i]), 0, _squeeze(p[i:j]), None, None

    def index(held: list[tuple]) -> Iterator[tuple]:
        own, keys, number = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), (np.uint64, np.int64, np.int32), strict=True))
        order = np.argsort(own, kind="stable")
        own, keys, number = own[order], keys[order], number[order]
        b = (own >> np.uint64(int(_BITS) - bits)).astype(np.int64)
        for i, j in _stretches(b):
            yield int(b[i]), 1, own[i:j].tobytes(), keys[i:j].tobytes(), number[i:j].tobytes()

    for _, rows in by_key(batches, 1):
        some, n, blocks, m = [], 0, [], 0
        for bucket, kind, data, keys, number in rows:
            if kind == 0:
                some.append(data)
                n += len(data) // 4
            elif kind == 1:
                blocks.append((data, keys, number))
                m += len(data) // 8
            else:
                yield bucket << more, kind, data, keys, number
            if n >= CHUNK:
                yield from probes(some)
                some, n = [], 0
            if m >= CHUNK:
                yield from index(blocks)
                blocks, m = [], 0
        if some:
            yield from probes(some)
        if blocks:
            yield from index(blocks)


def _stretches(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of the stretches of equal numbers."""
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else []
    return zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if len(cut) else iter(())


def _deal_runs(first: np.ndarray, second: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fine: np.ndarray, shift: int, begins: np.ndarray) -> Iterator[tuple]:
    """Rows of runs by their buckets, less shift bits. begins: where a run's windows begin in first and second."""
    b = fine >> shift
    order = np.argsort(b, kind="stable")
    for i, j in _stretches(b[order]):
        r = order[i:j]
        size = lengths[r]
        take = np.repeat(begins[r] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        yield int(b[r[0]]), 0, first[take].tobytes(), second[take].tobytes(), keys[r].tobytes(), starts[r].tobytes(), size.astype(np.int32).tobytes(), fine[r].astype(np.int32).tobytes()


def _deal_runs_again(batches, more: int, bits: int, whole: int) -> Iterator[tuple]:
    """Runs of coarse buckets, a chunk at a time, by buckets of so many more bits, of whole in the end."""
    kinds = (np.uint64, np.uint32, np.int64, np.int32, np.int32, np.int32)

    def deal(held: list[tuple]) -> Iterator[tuple]:
        first, second, keys, starts, lengths, fine = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True))
        yield from _deal_runs(first, second, keys, starts, lengths, fine, whole - bits, np.concatenate([[0], np.cumsum(lengths)[:-1]]))

    for _, rows in by_key(batches, 1):
        held, n = [], 0
        for bucket, kind, *data in rows:
            if kind:
                yield (bucket << more, kind, *data)
                continue
            held.append(tuple(data))
            n += len(data[0]) // 8
            if n >= CHUNK:
                yield from deal(held)
                held, n = [], 0
        if held:
            yield from deal(held)


def hit_blocks(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, blocks): the blocks of each document's grid whose words also start somewhere else, and perhaps a few others.

    docs: key, text. A probe is 48 bits of hash: false hits only add work.
    buckets is a power of two.
    """
    block, fan = (window + 1) // 2, min(buckets, FAN)
    schema = fields(("bucket", "int"), ("kind", "int"), ("probes", "binary"), ("keys", "binary"), ("blocks", "binary"))

    def probe(batches):
        for c in _chunks(batches, window):
            h = rolling(c.all, block) >> (np.uint64(64) - _BITS)
            whole = c.left[: len(h)] >= block
            values, counts = np.unique(h[whole], return_counts=True)
            grid = np.flatnonzero(whole & (c.place[: len(h)] % block == 0))
            own, keys, number = h[grid], c.ids[c.owner[grid]], (c.place[grid] // block).astype(np.int32)
            again = counts[np.searchsorted(values, own)] > 1
            yield int(c.ids[0]) % fan, 2, None, keys[again].tobytes(), number[again].tobytes()
            own, keys, number = own[~again], keys[~again], number[~again]
            order = np.argsort(own, kind="stable")
            own, keys, number = own[order], keys[order], number[order]
            edges = np.arange(fan + 1, dtype=np.uint64) << np.uint64(int(_BITS) - _log2(fan))
            a, b = np.searchsorted(values, edges), np.searchsorted(own, edges)
            for i in range(fan):
                if a[i] < a[i + 1]:
                    yield i, 0, _squeeze(values[a[i] : a[i + 1]]), None, None
                if b[i] < b[i + 1]:
                    s = slice(b[i], b[i + 1])
                    yield i, 1, own[s].tobytes(), keys[s].tobytes(), number[s].tobytes()

    def answer(batches):
        for _, rows in by_key(batches, 1):
            probes, index = [], []
            for _, kind, data, keys, number in rows:
                if kind == 0:
                    probes.append(_expand(data))
                elif kind == 1:
                    index.append((data, keys, number))
                else:
                    yield from zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(number, np.int32).tolist(), strict=True)
            if not index:
                continue
            p = np.sort(np.concatenate(probes))
            several = np.unique(p[1:][p[1:] == p[:-1]])
            for data, keys, number in index:
                own = np.frombuffer(data, np.uint64)
                at = np.minimum(np.searchsorted(several, own), max(0, len(several) - 1))
                hit = several[at] == own if len(several) else np.zeros(len(own), bool)
                yield from zip(np.frombuffer(keys, np.int64)[hit].tolist(), np.frombuffer(number, np.int32)[hit].tolist(), strict=True)

    sent = _refined(map_rows(docs, probe, schema, 256), buckets, _deal_probes, schema)
    return map_rows(sent, answer, fields(("key", "bigint"), ("block", "int")), 65_536).groupBy("key").agg(F.collect_set("block").alias("blocks"))


def repeated_runs(found: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, runs): ranges of starts of windows whose words also start somewhere else. found: key, text, blocks. buckets is a power of two."""
    block, fan = (window + 1) // 2, min(buckets, FAN)
    schema = fields(("bucket", "int"), ("kind", "int"), ("first", "binary"), ("second", "binary"), ("keys", "binary"), ("starts", "binary"), ("lengths", "binary"), ("fine", "binary"))

    def ranges(ids, at, begins):
        """(ids, first places, lengths) of the runs of at; begins: where a run ends besides gaps."""
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | begins]))
        return ids[cut], at[cut], np.diff(np.concatenate([cut, [len(at)]]))

    def send(batches):
        for c in _chunks(batches, window):
            n = len(c.all) - window + 1
            hit = np.zeros(len(c.all) + 1, np.int64)
            for s, blocks in zip(c.starts.tolist(), c.extra, strict=True):
                b = np.array(blocks, np.int64) * block + s
                np.add.at(hit, np.maximum(b - (window - block), s), 1)
                np.add.at(hit, b + 1, -1)
            near = (np.cumsum(hit)[:n] > 0) & (c.left[:n] >= window)
            at = np.flatnonzero(near)
            if not len(at):
                continue
            first, second = rolling(c.all, window, 0)[at], (rolling(c.all, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((second, first))
            same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
            again = np.zeros(len(at), bool)
            again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if again.any():
                own, places, size = ranges(c.owner[at[again]], at[again], np.diff(c.owner[at[again]]) != 0)
                yield int(c.ids[0]) % fan, 1, None, None, c.ids[own].tobytes(), c.place[places].tobytes(), size.astype(np.int32).tobytes(), None
            # The first of equal windows is sent.
            lead = np.ones(len(at), bool)
            lead[order[1:][same]] = False
            # The least of several hashes isn't spread evenly; mixed, it is.
            least = mixed(sliding_window_view(rolling(c.all, block), window - block + 1).min(1)[at[lead]])
            bucket = ((least >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            at, first, second, again = at[lead], first[lead], second[lead], again[lead]
            begins = (np.diff(bucket) != 0) | (np.diff(c.owner[at]) != 0) | (np.diff(again) != 0)
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | begins]))
            lengths = np.diff(np.concatenate([cut, [len(at)]]))
            # A run that is known to be repeated gets no reply.
            starts = np.where(again[cut], -1, c.place[at[cut]]).astype(np.int32)
            yield from _deal_runs(first, second, c.ids[c.owner[at[cut]]], starts, lengths, bucket[cut], _log2(buckets // fan), cut)

    def compare(batches):
        for _, rows in by_key(batches, 1):
            got = []
            for r in rows:
                if r[1]:
                    yield from zip(*(np.frombuffer(x, kind).tolist() for x, kind in zip(r[4:7], (np.int64, np.int32, np.int32), strict=True)), strict=True)
                else:
                    got.append(r[2:])
            if not got:
                continue
            join = lambda i, kind: np.frombuffer(b"".join(g[i] for g in got), kind)
            first, second, keys, starts, lengths = join(0, np.uint64), join(1, np.uint32), join(2, np.int64), join(3, np.int32), join(4, np.int32)
            order = np.lexsort((second, first))
            same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
            again = np.zeros(len(first), bool)
            again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            run = np.repeat(np.arange(len(keys)), lengths)
            offset = np.arange(len(first)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            at = np.flatnonzero(again & (starts[run] >= 0))
            if not len(at):
                continue
            own, places, size = ranges(run[at], at, np.diff(run[at]) != 0)
            yield from zip(keys[own].tolist(), (starts[own] + offset[places]).tolist(), size.tolist(), strict=True)

    sent = _refined(map_rows(found, send, schema, 256), buckets, lambda batches, more, bits: _deal_runs_again(batches, more, bits, _log2(buckets)), schema)
    runs = map_rows(sent, compare, fields(("key", "bigint"), ("start", "int"), ("n", "int")), 65_536)
    return runs.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def kept_words(text: str | None, runs: list, window: int) -> tuple[list[bytes], int]:
    """The words outside the windows that start in runs, and the number of the others."""
    words = (text or "").encode().split()
    cover = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        cover[r["start"]] += 1
        cover[r["start"] + r["n"] + window - 1] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the words of repeated windows.

    docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256 and
    kept_text (null where nothing is removed), one row per input row. Null and
    short texts keep all. A repeated row repeats all its windows, so both
    lose them. Words are compared as they are.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(4, int(size / 5 / BUCKET_PROBES).bit_length())
    hits = stage(hit_blocks(rows.select("key", "text"), window, buckets), "repeats")
    release(spark)
    found = stage(rows.join(hits, "key").select("doc_id", "key", "text", "blocks"), "repeats")
    release(spark)
    runs = stage(repeated_runs(found.select("key", "text", "blocks"), window, buckets), "repeats")
    release(spark)
    drop_stage(hits)

    def cut(batches):
        for batch in batches:
            for doc_id, key, text, r in batch:
                kept, n = kept_words(text, r, window)
                whole = b" ".join(kept)
                yield doc_id, key, n, hashlib.sha256(whole).hexdigest(), whole.decode()

    changed = map_rows(found.join(runs, "key").select("doc_id", "key", "text", "runs"), cut, fields(("doc_id", kind), ("key", "bigint"), ("n_removed", "bigint"), ("cut_sha256", "string"), ("kept_text", "string")))
    changed = stage(changed.dropDuplicates(["doc_id", "key"]), "repeats")
    release(spark)

    def whole(batches):
        for batch in batches:
            for doc_id, key, text in batch:
                words = (text or "").encode().split()
                yield doc_id, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest()

    base = map_rows(rows, whole, fields(("doc_id", kind), ("key", "bigint"), ("n_words", "bigint"), ("whole_sha256", "string")))
    out = base.alias("b").join(changed.alias("c"), (F.col("b.key") == F.col("c.key")) & F.col("b.doc_id").eqNullSafe(F.col("c.doc_id")), "left")
    return out.select("b.doc_id", "b.n_words", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("c.cut_sha256", "b.whole_sha256").alias("kept_sha256"), "c.kept_text")


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
