"""Baseline JPEG frames, decoded by arrays.

Any Huffman-coded frame of 8 bits with one scan for each set of components is
read: grey or colour, subsampled or not, with restart markers, and with the
standard tables where a frame brings none, as motion-JPEG frames may. Codes
are looked up by the 16 bits at each place; the inverse transform is done for
all blocks together.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: The standard Huffman tables, as numbers of codes of each length and symbols in order (luminance, then chrominance).
DC_COUNTS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
AC_COUNTS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


def _ac_symbols(which: int) -> bytes:
    """The named symbols, then all others of 1 to 10 bits after 0 to 15 zeros, in rising order."""
    first = bytes.fromhex(AC_FIRST[which])
    return first + bytes(s for s in range(256) if 1 <= s & 15 <= 10 and s not in first)


def _zigzag() -> np.ndarray:
    """Row-major places of an 8x8 block in the order of its diagonals."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_BASIS = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])


def lookup(counts: tuple[int, ...] | bytes, symbols: bytes) -> list[int]:
    """length << 8 | symbol for each 16 bits that a code begins; 0 where none does."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if code >> length:
                raise ValueError("a Huffman table has too many codes")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


def standard_tables() -> dict[tuple[int, int], list[int]]:
    """By (class, number)."""
    return {(0, i): lookup(DC_COUNTS[i], bytes(range(12))) for i in (0, 1)} | {(1, i): lookup(AC_COUNTS[i], _ac_symbols(i)) for i in (0, 1)}


_STANDARD: dict[tuple[int, int], list[int]] = {}


@dataclass
class Component:
    """A colour component: its sampling, tables and quantised coefficients."""

    name: int
    across: int
    down: int
    quantiser: int
    columns: int = 0
    rows: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0))


class _Bits:
    """The bits of a stretch between markers: at[i] is the 32 bits from bit i on."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.uint64)
        n = len(raw) - 8
        word = np.zeros(n, np.uint64)
        for i in range(5):
            word |= raw[i : n + i] << np.uint64(8 * (4 - i))
        self.at = ((word[:, None] >> np.arange(8, 0, -1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).ravel().tolist()
        self.place = 0


def _block(bits: _Bits, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
    """Reads a block's coefficients in zigzag order into out; returns its DC level."""
    at, place = bits.at, bits.place
    try:
        word = at[place]
        code = dc[word >> 16]
        length, size = code >> 8, code & 255
        if not length:
            raise ValueError("no such Huffman code")
        place += length
        if size:
            v = at[place] >> (32 - size)
            before += v if v >> (size - 1) else v - (1 << size) + 1
            place += size
        out[0] = before
        k = 1
        while k < 64:
            word = at[place]
            code = ac[word >> 16]
            length, symbol = code >> 8, code & 255
            if not length:
                raise ValueError("no such Huffman code")
            place += length
            size = symbol & 15
            if size:
                k += symbol >> 4
                v = at[place] >> (32 - size)
                out[k] = v if v >> (size - 1) else v - (1 << size) + 1
                place += size
                k += 1
            elif symbol == 0xF0:
                k += 16
            else:
                break
    except IndexError:
        raise ValueError("the scan ends too early") from None
    bits.place = place
    return before


def components(data: bytes) -> tuple[int, int, list[np.ndarray]]:
    """Width, height, and the samples of each component in its own resolution. ValueError for what isn't a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, quantisers, size, interval = 2, {}, None, 0
    tables: dict[tuple[int, int], list[int]] = {}
    parts: list[Component] = []
    seen: set[int] = set()
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            if parts and len(seen) == len(parts):
                break  # the end marker is missing
            raise ValueError("a frame without a scan")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                quantisers[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("only frames of 8 bits and known height are read")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            size = (width, height)
            across, down = max(p.across for p in parts), max(p.down for p in parts)
            for p in parts:
                p.columns = -(-(-(-width * p.across // across)) // 8)
                p.rows = -(-(-(-height * p.down // down)) // 8)
                whole = (-(-height // (8 * down)) * p.down, -(-width // (8 * across)) * p.across)
                p.blocks = np.zeros((*whole, 64), np.int32)
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            if size is None:
                raise ValueError("a scan before its frame")
            end = _scan(data, at, body, parts, tables, interval)
            seen |= set(body[1 : 1 + 2 * body[0] : 2])
            at = end
    if size is None or len(seen) < len(parts):
        raise ValueError("a frame without a scan")
    return *size, [_samples(p, quantisers, size, max(q.across for q in parts), max(q.down for q in parts)) for p in parts]


def _scan(data: bytes, at: int, body: bytes, parts: list[Component], tables: dict, interval: int) -> int:
    """Reads a scan's blocks; returns where the next marker is."""
    if not _STANDARD:
        _STANDARD.update(standard_tables())
    by_name = {p.name: p for p in parts}
    used = []
    for i in range(body[0]):
        name, t = body[1 + 2 * i], body[2 + 2 * i]
        p = by_name.get(name)
        keys = (0, t >> 4), (1, t & 15)
        if p is None or any(k not in tables and k not in _STANDARD for k in keys):
            raise ValueError("a scan of unknown components or tables")
        used.append((p, *(tables.get(k) or _STANDARD[k] for k in keys)))
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
    stop = end.start() if end else len(data)
    stretches = re.split(rb"\xff[\xd0-\xd7]", data[at:stop])
    if len(used) == 1:
        p = used[0][0]
        places = [[(0, y, x)] for y in range(p.rows) for x in range(p.columns)]
    else:
        p = used[0][0]
        tall, wide = p.blocks.shape[0] // p.down, p.blocks.shape[1] // p.across
        inside = [(i, dy, dx) for i, (q, _, _) in enumerate(used) for dy in range(q.down) for dx in range(q.across)]
        places = [[(i, y * used[i][0].down + dy, x * used[i][0].across + dx) for i, dy, dx in inside] for y in range(tall) for x in range(wide)]
    per = interval or len(places)
    for first in range(0, len(places), per):
        if not stretches:
            raise ValueError("the scan ends too early")
        bits, level = _Bits(stretches.pop(0)), [0] * len(used)
        for unit in places[first : first + per]:
            for i, y, x in unit:
                p, dc, ac = used[i]
                level[i] = _block(bits, dc, ac, level[i], p.blocks[y, x])
    return stop


def _samples(p: Component, quantisers: dict, size: tuple[int, int], across: int, down: int) -> np.ndarray:
    if p.quantiser not in quantisers:
        raise ValueError("a quantiser is missing")
    tall, wide, _ = p.blocks.shape
    flat = np.zeros((tall * wide, 64))
    flat[:, ZIGZAG] = p.blocks.reshape(-1, 64) * quantisers[p.quantiser]
    levels = _BASIS.T @ flat.reshape(-1, 8, 8) @ _BASIS + 128
    image = levels.reshape(tall, wide, 8, 8).swapaxes(1, 2).reshape(tall * 8, wide * 8)
    height, width = -(-size[1] * p.down // down), -(-size[0] * p.across // across)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)[:height, :width]


def luma(data: bytes) -> np.ndarray:
    """The grey picture of a frame: its first component, height by width."""
    width, height, parts = components(data)
    first = parts[0]
    rows = np.arange(height) * first.shape[0] // height
    return first[rows][:, np.arange(width) * first.shape[1] // width]
