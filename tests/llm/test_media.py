from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logwarden.llm import jpeg, media

from .helpers import edge_docs, no_docs


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_round_trip(data):
    payload = data + b"\x00" * (-len(data) % 64)
    assert media.decode_avi(media.encode_avi(payload)).payload == payload


def test_blocks_decode_by_the_inverse_transform():
    """A decoder's own arithmetic on the DC coefficient gives the byte back."""
    basis = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    for byte in (0, 1, 127, 128, 200, 255):
        coefficients = np.zeros((8, 8))
        coefficients[0, 0] = (byte - 128) * 8
        assert np.allclose(basis.T @ coefficients @ basis + 128, byte)


def test_shots():
    dark, light = bytes([10]) * media.FRAME, bytes([240]) * media.FRAME
    video = media.decode_avi(media.encode_avi(dark * 3 + light * 4 + dark * 2))
    assert [(c.first, c.last) for c in video.clips] == [(0, 2), (3, 6), (7, 8)]
    assert video.clips[1].start == pytest.approx(3 / media.FPS)


def test_damaged_files_are_errors():
    good = media.encode_avi(b"a" * 64)
    with pytest.raises(ValueError):
        media.decode_avi(b"RIFX" + good[4:])
    with pytest.raises(ValueError):
        media.levels(b"\x00" * 40)


def picture(spark, kind, width, height, seed):
    """A picture made and written by Java's own encoder, and what Java reads back: (bytes, grey levels or RGB)."""
    jvm = spark._jvm
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    plane = lambda k: np.clip(128 + 90 * np.sin(x / (7 + k) + seed) * np.cos(y / (5 + k)) + r.normal(0, 12, (height, width)), 0, 255).astype(int)
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if kind == "grey" else 1)
    red, green, blue = plane(0), plane(3), plane(9)
    values = (red << 16) | ((red if kind == "grey" else green) << 8) | (red if kind == "grey" else blue)
    for j in range(height):
        for i in range(width):
            image.setRGB(i, j, int(values[j, i]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    raster = back.getRaster()
    bands = np.array([[[raster.getSample(i, j, b) for b in range(raster.getNumBands())] for i in range(width)] for j in range(height)])
    return data, bands


@pytest.mark.parametrize(("kind", "width", "height"), [("grey", 40, 24), ("grey", 17, 9), ("colour", 48, 32), ("colour", 33, 19)])
def test_frames_of_another_encoder(spark, kind, width, height):
    data, bands = picture(spark, kind, width, height, 3)
    got = jpeg.luma(data).astype(int)
    want = bands[..., 0] if kind == "grey" else bands @ np.array([0.299, 0.587, 0.114])
    assert got.shape == (height, width)
    # A colour picture's grey is compared after Java's rounding and clipping of three colours.
    assert np.abs(got - want).max() <= (1 if kind == "grey" else 40) and np.abs(got - want).mean() <= (0.1 if kind == "grey" else 3)


def test_foreign_files_have_clips(spark):
    """Pictures of another encoder in a file without a payload's length, by index, by file offsets, and without an index."""
    frames = [picture(spark, "colour", 32, 16, s)[0] for s in (1, 1, 50, 50, 50)]
    frames[2:] = [media.encode_jpeg(np.full(8, 250, np.uint8), 4)] * 3
    good = media.encode_avi(b"a" * 64)
    movi, index, at = [], {"movi": b"", "file": b""}, 4
    head = good[: good.index(b"LIST", 12 + 8)]
    first = good.index(b"movi") - 8
    hdrl = good[12 : first][: good[12:first].index(b"INFO") - 8]
    base = 12 + len(hdrl) + 8
    for f in frames:
        c = media._chunk(b"00dc", f)
        for how, start in (("movi", at), ("file", base + at)):
            index[how] += media.struct.pack("<4sIII", b"00dc", 16, start, len(f))
        movi.append(c)
        at += len(c)
    assert head
    for idx in (index["movi"], index["file"], None):
        tail = media._chunk(b"idx1", idx) if idx else b""
        data = media._chunk(b"RIFF", b"AVI " + hdrl + media._list(b"movi", *movi) + tail)
        video = media.decode_avi(data)
        assert video.payload == b"" and [(c.first, c.last) for c in video.clips] == [(0, 1), (2, 4)]
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:60])), (3, None), (4, bytearray(b"RIFF"))], "k long, media binary")
    got = {(r.k, r.clip, r.error is None) for r in media.read_clips(rows, "k").collect()}
    assert got == {(1, 0, True), (1, 1, True), (2, None, False), (4, None, False)}


def test_restarts_and_missing_tables(spark):
    """A frame with restart markers, and one whose Huffman tables are left out, as in many motion-JPEG files."""
    data, bands = picture(spark, "grey", 40, 24, 8)
    parts, at = [b"\xff\xd8"], 2
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] != 0xC4:
            parts.append(data[at : at + n])
        at += n
    bare = b"".join(parts) + data[at:]
    assert len(bare) < len(data) and (jpeg.luma(bare) == jpeg.luma(data)).all()
    # One grey block a stretch: DC 80, then no other coefficients, by the standard tables.
    size = media._segment(0xC0, media.struct.pack(">BHHB", 8, 8, 24, 1) + bytes([1, 0x11, 0]))
    quantiser = media._segment(0xDB, b"\x00" + bytes([8] * 64))
    block = int("11110" + "1010000" + "1010" + "1" * 8, 2).to_bytes(3, "big")
    scan = block + b"\xff\xd0" + block + b"\xff\xd1" + block
    frame = b"\xff\xd8" + quantiser + size + media._segment(0xDD, b"\x00\x01") + media._SCAN + scan + b"\xff\xd9"
    assert (jpeg.luma(frame) == 208).all()
    with pytest.raises(ValueError):
        jpeg.luma(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_digests(spark):
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), edge_docs(spark)):
        want = []
        for r in docs.collect():
            raw = (r.text or "").encode()
            p = raw + b"\x00" * (64 if not raw else -len(raw) % 64)
            want.append((r.doc_id if r.doc_id is not None else -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        got = media.media_digests(docs).collect()
        for r in got:
            assert [(c.first_frame, c.start_s) for c in r.clips] == [(int(x), int(x) / media.FPS) for x in r.feature.split(":")[-1].split(",")]
        text = {r.doc_id: r.text for r in docs.collect()}
        for r in got[:40]:
            if r.doc_id not in (None, 5):
                stored = media.encode_avi(media.padded(text[r.doc_id])[0])
                assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert sorted(want) == sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert media.media_digests(no_docs(spark)).collect() == []


def test_columns_and_clips(spark):
    stored = media.store_media(edge_docs(spark), media="score")
    assert set(stored.columns) == set(edge_docs(spark).columns)
    clips = media.read_clips(stored.where("doc_id = 8"), "doc_id", "score").collect()
    assert clips[0].first_frame == 0 and all(c.end_s > c.start_s for c in clips)
