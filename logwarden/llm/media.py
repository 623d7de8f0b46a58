"""Media columns: AVI motion-JPEG.

A payload of bytes becomes an AVI file whose frames are baseline grey JPEG
images. Each payload byte is one 8x8 block of one grey level: with a DC
quantiser of 8, the block's DC coefficient is the byte less 128, so every
JPEG decoder gives the byte back exactly. The Huffman table of the DC
differences gives category k a code of 9 - k bits, and k more bits follow it,
so that with the one-bit end-of-block code each block takes 10 bits. Encoding
and decoding are then table lookups over whole arrays.

Reading parses the RIFF tree and its idx1 index, and finds shots where the grey
histogram of the frames changes by more than the recent mean and deviations.
Frames of other makers are decoded in full, by jpeg; frames as written here
have one grey level a block, and their codes are looked up at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import by_bytes, fields, map_rows, stage

BLOCK_COLUMNS = 64
BLOCK_ROWS = 32
FRAME = BLOCK_COLUMNS * BLOCK_ROWS
FPS = 25
UNIT = 64
_DC_CATEGORIES = bytes(range(8, -1, -1))


def _difference_codes() -> np.ndarray:
    """10 bits for each difference from -255 to 255: Huffman code, extra bits, end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << k) - 1
        out[d + 255] = ((((1 << (8 - k)) - 1) << 1) << k | extra) << 1
    return out


_CODES = _difference_codes()
_DIFFERENCES = np.full(1024, 9999, np.int32)
_DIFFERENCES[_CODES.astype(np.int64)] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_DHT_DC = bytes([0x00]) + bytes([1] * 9 + [0] * 7) + _DC_CATEGORIES
_DHT_AC = bytes([0x10]) + bytes([1] + [0] * 15) + b"\x00"
_TABLES = _segment(0xDB, b"\x00" + bytes([8] * 64)) + _segment(0xC4, _DHT_DC) + _segment(0xC4, _DHT_AC)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_jpeg(samples: np.ndarray, columns: int) -> bytes:
    """A grey baseline JPEG of one 8x8 block for each sample; len(samples) is a multiple of columns and of 4."""
    rows = len(samples) // columns
    dc = samples.astype(np.int32) - 128
    f = _CODES[np.diff(dc, prepend=0) + 255].reshape(-1, 4)
    packed = (f[:, 0] << np.uint64(30)) | (f[:, 1] << np.uint64(20)) | (f[:, 2] << np.uint64(10)) | f[:, 3]
    bits = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0]))
    return b"\xff\xd8" + _TABLES + frame + _SCAN + bits.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def block_levels(data: bytes) -> np.ndarray | None:
    """The grey level of each block, in order, of a frame as encode_jpeg writes it; None for any other."""
    if not data.startswith(b"\xff\xd8" + _TABLES) or data[-2:] != b"\xff\xd9":
        return None
    at = 2 + len(_TABLES)
    height, width, n = struct.unpack_from(">HHB", data, at + 5)
    bits_at = at + 13 + len(_SCAN)
    if data[at : at + 2] != b"\xff\xc0" or n != 1 or data[at + 13 : bits_at] != _SCAN:
        return None
    n = (height // 8) * (width // 8)
    bits = data[bits_at:-2].replace(b"\xff\x00", b"\xff")
    if n % 4 or len(bits) != n // 4 * 5:
        return None
    raw = np.zeros((n // 4, 8), np.uint8)
    raw[:, 3:] = np.frombuffer(bits, np.uint8).reshape(-1, 5)
    v = raw.view(">u8").ravel().astype(np.uint64)
    f = np.empty((len(v), 4), np.int64)
    for k, shift in enumerate((30, 20, 10, 0)):
        f[:, k] = (v >> np.uint64(shift)) & np.uint64(1023)
    d = _DIFFERENCES[f.ravel()]
    if len(d) and d.max() > 255:
        return None
    return (np.cumsum(d) + 128).astype(np.uint8)


def levels(data: bytes) -> np.ndarray:
    """Grey levels of a frame: of its blocks, if it was written here, else of its pixels. ValueError for what isn't a baseline frame."""
    found = block_levels(data)
    return jpeg.luma(data).ravel() if found is None else found


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def encode_avi(payload: bytes) -> bytes:
    """payload, of a positive multiple of 64 bytes, as an AVI file. The last frame is filled up; an info chunk holds the length."""
    data = np.frombuffer(payload, np.uint8)
    if len(data) >= FRAME:
        columns, per = BLOCK_COLUMNS, FRAME
    else:
        columns, per = BLOCK_COLUMNS, len(data)
    fill = -len(data) % per
    if fill:
        data = np.concatenate([data, np.full(fill, data[-1], np.uint8)])
    frames = [encode_jpeg(data[i : i + per], columns) for i in range(0, len(data), per)]
    width, height = columns * 8, per // columns * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IIIHH4sIIIII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    info = _list(b"INFO", _chunk(b"ICMT", f"payload={len(payload)}".encode()))
    return _chunk(b"RIFF", b"AVI " + _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf))) + info + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, length) of the chunks; for a list, the kind is its form type."""
    while at + 8 <= end:
        kind, length = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind in (b"LIST", b"RIFF"):
            yield data[at + 8 : at + 12], at + 12, length - 4
        else:
            yield kind, at + 8, length
        at += 8 + length + length % 2


@dataclass
class Clip:
    """Frames first to last, and their time in seconds."""

    first: int
    last: int
    start: float
    end: float


@dataclass
class Video:
    payload: bytes
    frames: int
    width: int
    height: int
    clips: list[Clip]


def parse_avi(data: bytes) -> tuple[list[bytes], int, dict]:
    """The frames by the file's index, or as they lie if it has none, the payload's length (or -1), and width, height and micros a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, size, index, payload, head = 0, 0, b"", -1, {}
    for kind, at, n in _walk(data, 12, len(data)):
        if kind == b"movi":
            movi, size = at, n
        elif kind == b"idx1":
            index = data[at : at + n]
        elif kind == b"INFO":
            for k, a, m in _walk(data, at, at + n):
                if k == b"ICMT" and data[a : a + 8] == b"payload=":
                    payload = int(data[a + 8 : a + m])
        elif kind == b"hdrl":
            for k, a, _ in _walk(data, at, at + n):
                if k == b"avih":
                    v = struct.unpack_from("<14I", data, a)
                    head = {"micros": v[0], "width": v[8], "height": v[9]}
    if not movi or not head:
        raise ValueError("an AVI file without frames or header")
    out = []
    for kind, _, offset, length in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]):
        if kind[2:] in (b"dc", b"db"):
            # Offsets are from the list's type on, or from the file's start.
            at = movi - 4 + offset if data[movi - 4 + offset : movi + offset] == kind else offset
            if data[at : at + 4] != kind:
                raise ValueError("the index does not fit the frames")
            out.append(data[at + 8 : at + 8 + length])
    return (out if index else list(_frames(data, movi, movi + size))), payload, head


def _frames(data: bytes, at: int, end: int) -> Iterator[bytes]:
    for kind, start, n in _walk(data, at, min(end, len(data))):
        if kind == b"rec ":
            yield from _frames(data, start, start + n)
        elif kind[2:] in (b"dc", b"db"):
            yield data[start : start + n]


def shots(histograms: np.ndarray, window: int = 8, deviations: float = 3.0, least: float = 0.25) -> list[int]:
    """First frames of shots. A cut is where the share of changed grey levels exceeds least, and the mean of up to window changes before it in its shot by some deviations."""
    cuts = [0] if len(histograms) else []
    if len(histograms) > 1:
        change = np.abs(np.diff(histograms, axis=0)).sum(1) / (2 * np.maximum(histograms[1:].sum(1), 1))
        for i, c in enumerate(change):
            before = change[max(cuts[-1], i - window) : i]
            if c > least and (not len(before) or c > before.mean() + deviations * before.std()):
                cuts.append(i + 1)
    return cuts


def decode_avi(data: bytes, bins: int = 16) -> Video:
    """The payload, empty if the file names none, and clips from cut to cut."""
    frames, length, head = parse_avi(data)
    found = [levels(f) for f in frames]
    shift = 8 - (bins - 1).bit_length()
    hist = np.array([np.bincount(x >> shift, minlength=bins) for x in found])
    at, rate = shots(hist), head["micros"] / 1e6
    clips = [Clip(a, b - 1, a * rate, b * rate) for a, b in zip(at, [*at[1:], len(frames)], strict=True)]
    payload = b"".join(x.tobytes() for x in found)[:length] if length >= 0 else b""
    return Video(payload, len(frames), head["width"], head["height"], clips)


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of 64, and their number without these."""
    raw = (text or "").encode()
    return raw + b"\x00" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the column media: each row's text as an AVI file. A null text counts as empty. Other columns are kept; a column named like media is replaced. About 8 MB of texts are held at a time, or one longer text."""
    keep = [c for c in docs.columns if c != media]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(media, T.BinaryType())])

    def run(batches):
        for b in by_bytes(batches, text):
            got = pa.array([encode_avi(padded(t)[0]) for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [got], names=[*keep, media])

    return docs.mapInArrow(run, schema)


CLIP = "struct<first_frame:int,last_frame:int,start_s:double,end_s:double>"


def read_clips(media_rows: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per clip of each AVI value: key, clip, first_frame, last_frame, start_s, end_s, error. A null value has no rows; one that is damaged, or holds frames that aren't baseline JPEG, has a row with the error only."""
    schema = fields((key, media_rows.schema[key].dataType.simpleString()), ("clip", "int"), ("first_frame", "int"), ("last_frame", "int"), ("start_s", "double"), ("end_s", "double"), ("error", "string"))

    def run(batches):
        for rows in batches:
            for k, data in rows:
                if data is None:
                    continue
                try:
                    for i, c in enumerate(decode_avi(data).clips):
                        yield k, i, c.first, c.last, c.start, c.end, None
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    yield k, None, None, None, None, None, str(e) or type(e).__name__

    return map_rows(media_rows.select(key, media), run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: what its stored AVI file gives back, and its clips.

    The media column is written to the shared folder and read back from
    there. Null text: as empty (a payload of 64 zeros). Equal texts give equal
    values. Repeated and null ids are kept as they are; other columns are
    not read. Neither step shuffles.
    """
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = stage(store_media(sized).drop("text"), "media")
    schema = fields(
        ("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"),
        ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("clips", f"array<{CLIP}>"),
    )

    def run(batches):
        for rows in batches:
            for doc_id, n, data in rows:
                got = decode_avi(data)
                back = got.payload
                cuts = ",".join(str(c.first) for c in got.clips)
                clips = [{"first_frame": c.first, "last_frame": c.last, "start_s": c.start, "end_s": c.end} for c in got.clips]
                yield doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"mjpeg:{got.width}x{got.height}:{got.frames}:{cuts}", clips

    return map_rows(stored, run, schema)
