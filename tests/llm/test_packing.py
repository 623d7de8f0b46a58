from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import bpe, packing

from .helpers import edge_docs, no_docs


def check(docs, pieces, window=4096):
    """Every id in exactly one piece, gapless sequences, right checksums, little padding."""
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {}
    for d, text in docs:
        x = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        ids[d, len(x)] = x
    want = Counter()
    for d, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        want[d, n] += n
    got, by_seq = Counter(), defaultdict(list)
    for p in pieces:
        x = ids[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert len(x) == p.length > 0
        assert zlib.crc32(array("I", x).tobytes()) == p.ids_crc32
        got[p.doc_id, p.doc_tokens] += p.length
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert got == want
    pad = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(1, sum(want.values()))


def test_sample_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, packing.pack(docs, packing.tokenizer_path()).collect()) < 0.02
    docs = edge_docs(spark)
    pieces = packing.pack(docs, packing.tokenizer_path()).collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], pieces) < 0.02
    assert packing.pack(no_docs(spark), packing.tokenizer_path()).collect() == []


def test_starts_are_disjoint(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    seen = {}
    for p in packing.pack(docs, packing.tokenizer_path()).collect():
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for parts in seen.values():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n


def test_least_squares_recovers_a_mixture():
    rows = packing.combinations(16)
    assert all(r.sum() == 16 for r in rows)
    x = np.zeros(len(rows))
    x[[3, 10]] = [40, 25]
    hist = np.bincount(rows.ravel(), np.repeat(x, 3), 17).astype(int)
    counts = packing.rounded(rows, packing.nnls(rows, hist), hist)
    used = np.bincount(rows.ravel(), np.repeat(counts, 3), 17)
    assert (used[1:] <= hist[1:]).all() and used[1:].sum() >= 0.95 * hist[1:].sum()


@pytest.mark.parametrize("text", ["Hello, World's 12", "a b c", "ΣΑΣ ς İ", "x" * 200 + " y", "<|endoftext|>Ab", "Élève, straße!! NAÏVE*** ÿ<| abc<|endoftext|>", "don't a'b x_y a1 ¼ ªº µ", "a\x1cb\x1fc \x1d \u2003d\xa0e", "e\u0301te\u0301 A\u030a"])
def test_words_give_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert bpe.merges_of(path)
    texts = pa.array(["first", None, text, "", f"{text}\t\x0b{text}"])
    got = list(bpe.Ids(path).of_texts(texts, 2))
    assert got[2] == array("I", [*whole, 2]).tobytes() and got[1] == got[3] == array("I", [2]).tobytes()
    assert list(bpe.Ids(path).of_texts(texts.slice(2), 2)) == got[2:]
    assert got[4] == array("I", [*whole, *whole, 2]).tobytes()


@pytest.mark.parametrize("text", ["Hello,  World's 12\n x", "", "a\x1cb\u2003c"])
def test_other_tokenizers_get_whole_texts(text):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    assert not bpe.merges_of(path)
    want = array("I", [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 7]).tobytes()
    assert list(bpe.Ids(path).of_texts(pa.array([text]), 7)) == [want]


def test_merges_of_many_words(spark):
    """Words of the test texts, and random ones, one by one."""
    import random

    r = random.Random(2)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["".join(r.choice("abeinrstXYZÄéÿß×÷'.,-_<|>0159\u0301ŁЖ中") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += ["xa" * 30, "ééééé" * 9, "", "''", "<|EndOfText|>", "a<|startoftext|>b"]
    path = packing.tokenizer_path()
    t = bpe.tokenizer(path)
    want = [array("I", [*e.ids, 2]).tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert list(bpe.Ids(path).of_texts(pa.array(texts), 2)) == want


def test_a_hot_bin_is_ranked_in_stretches(spark, monkeypatch):
    """Nearly all documents fall in one bin; ranks within it still are gapless."""
    monkeypatch.setattr(packing, "RANKED_BITS", 4)
    rows = [(i, "alpha beta gamma") for i in range(700)] + [(i, "w " * (37 * i % 9000)) for i in range(700, 720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check(rows, packing.pack(docs, packing.tokenizer_path()).collect()) < 0.02
