"""Token ids of batches of texts.

For a tokenizer that drops white space, lowers letters and splits words into
runs of letters, single digits and runs of marks, the ids of a text are those
of its pieces, one after another. Texts are split and their words and pieces
are numbered by Arrow, so each distinct piece of a batch is merged once, and
the merges of all pieces of a length are done together, as array operations.
Words with other characters go through the tokenizer itself, and so do whole
texts if the tokenizer is of another make.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of more bytes are merged by the tokenizer.
LONG_PIECE = 24
#: Other words that are remembered; longer ones than LONG_WORD never are.
OTHER_WORDS = 1 << 16
LONG_WORD = 64
#: The normaliser and splitter that pieces() follows.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_NONE = np.int32(1 << 30)
_OTHER, _LETTER, _DIGIT, _MARK, _LEAD = range(5)


def _byte_letters() -> list[str]:
    """The byte-level alphabet: a printable byte is the character of its number, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _classes() -> np.ndarray:
    """What each byte is at the start of a character; an apostrophe is other, as contractions are split in their own way."""
    out = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    out[ord("'")] = _OTHER
    out[0xC3] = _LEAD
    return out


_CLASS = _classes()


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merges:
    """The merges of a byte-level model with an end-of-word mark, for many pieces at once."""

    def __init__(self, model: dict, added: list[str]) -> None:
        #: Tokens that are found before words are split.
        self.added = added
        vocab, mark, letters = model["vocab"], model["end_of_word_suffix"], _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + mark, -1) for c in letters], np.int32)
        self.size = np.int64(len(vocab))
        rows = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rows.append((vocab[a] * len(vocab) + vocab[b], rank, vocab[a + b]))
        rows.sort()
        self.keys, ranks, made = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        self.ranks, by_rank = ranks.astype(np.int32), np.empty(len(rows), np.int32)
        by_rank[ranks] = made
        self.made = by_rank

    @property
    def complete(self) -> bool:
        return bool((self.inner >= 0).all() and (self.last >= 0).all())

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number if it isn't merged or b is no symbol (-1)."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], _NONE)

    def merged(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one length (rows of bytes), filled up with -1, and their numbers. The pair of the least rank, the first of several, is merged until there is none."""
        n, width = pieces.shape
        ids = self.inner[pieces]
        ids[:, -1] = self.last[pieces[:, -1]]
        counts = np.full(n, width)
        if width == 1:
            return ids, counts
        out = ids.copy()
        rows, ranks = np.arange(n), self._rank(ids[:, :-1], ids[:, 1:])
        columns = np.arange(width)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == _NONE
            if ended.any():
                out[rows[ended]] = ids[ended]
                rows, ids, ranks, at, best = rows[~ended], ids[~ended], ranks[~ended], at[~ended], best[~ended]
            if not len(rows):
                return out, (out >= 0).sum(1)
            here = np.arange(len(rows))
            # What is behind the pair moves one place up.
            after = columns[None] > at[:, None]
            moved = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, np.int32)], 1)
            ids = np.where(after, moved, ids)
            ids[here, at] = self.made[best]
            if ranks.shape[1] > 1:
                up = np.concatenate([ranks[:, 1:], np.full((len(rows), 1), _NONE, np.int32)], 1)
                ranks = np.where(after[:, :-1], up, ranks)
            right = np.minimum(at + 1, width - 1)
            has_right = at + 1 < width
            new = self._rank(ids[here, at], np.where(has_right, ids[here, right], -1))
            inside = at < ranks.shape[1]
            ranks[here[inside], at[inside]] = new[inside]
            before = at > 0
            ranks[here[before], at[before] - 1] = self._rank(ids[here[before], at[before] - 1], ids[here[before], at[before]])


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges | None:
    """The tokenizer's merges, or None if it is of another make than pieces() follows."""
    said = json.loads(tokenizer(path).to_str())
    model = said["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and model.get("end_of_word_suffix")
    if not plain or said["normalizer"] != NORMALISER or said["pre_tokenizer"] != SPLITTER:
        return None
    added = [t["content"] for t in said["added_tokens"]]
    if any(re.search(r"\s", t) for t in added):
        return None
    made = Merges(model, added)
    return made if made.complete else None


def _ragged(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of ranges that begin at first and have sizes items; and where each range ends in these, after a 0."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes), ends


class Ids:
    """Ids of batches of texts by one tokenizer. Memory is bounded by the batches and the table of other words."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.merges = tokenizer(path), merges_of(path)
        self.others: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _other(self, word: str) -> bytes:
        got = self.others.get(word)
        if got is None:
            got = self._whole(word)
            if len(word) <= LONG_WORD:
                if len(self.others) >= OTHER_WORDS:
                    self.others.clear()
                self.others[word] = got
        return got

    def of_pieces(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece (sizes bytes of data from first on)."""
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        take, _ = _ragged(first, sizes)
        pieces = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))]).dictionary_encode()
        kinds = pieces.dictionary
        if not len(kinds):
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        raw = np.frombuffer(kinds.buffers()[2], np.uint8)
        start = np.frombuffer(kinds.buffers()[1], np.int32, len(kinds) + 1).astype(np.int64)
        length, start = np.diff(start), start[:-1]
        found: list[np.ndarray] = []
        order: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for width in np.unique(length).tolist():
            some = np.flatnonzero(length == width)
            if width > LONG_PIECE:
                got = [np.frombuffer(self._whole(raw[s : s + width].tobytes().decode()), np.uint32).astype(np.int32) for s in start[some].tolist()]
                n = np.array([len(g) for g in got])
                found.append(np.concatenate(got))
            else:
                ids, n = self.merges.merged(raw[start[some][:, None] + np.arange(width)])
                found.append(ids[ids >= 0])
            order.append(some)
            counts.append(n)
        number, n_ids = np.empty(len(kinds), np.int64), np.concatenate(counts)
        number[np.concatenate(order)] = np.arange(len(kinds))
        begin = np.cumsum(n_ids) - n_ids
        which = number[pieces.indices.to_numpy()]
        take, _ = _ragged(begin[which], n_ids[which])
        return np.concatenate(found).astype(np.uint32)[take], n_ids[which]

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word."""
        n = len(words)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + words.offset + 1)[words.offset :].astype(np.int64)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        kind = _CLASS[data]
        # A Latin-1 letter: the lead byte C3, and one of 80 to BF but for the signs of multiplication and division.
        lead = np.flatnonzero(kind == _LEAD)
        tail = np.minimum(lead + 1, max(len(data) - 1, 0))
        letter = (data[tail] != 0x97) & (data[tail] != 0xB7)
        kind[lead] = np.where(letter, _LETTER, _OTHER)
        kind[tail[letter]] = _LETTER
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        upper = tail[letter & (data[tail] >= 0x80) & (data[tail] <= 0x9E)]
        low[upper] += 32
        owner = np.repeat(np.arange(n), np.diff(offsets))
        simple = np.ones(n, bool)
        simple[owner[kind == _OTHER]] = False
        for token in self.merges.added:
            simple &= ~pc.match_substring(words, token, ignore_case=True).to_numpy(zero_copy_only=False)
        use = simple[owner]
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begins[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = np.flatnonzero(begins)
        size = np.diff(np.concatenate([at, [len(data)]]))
        keep = use[at]
        at, size = at[keep], size[keep]
        ids, counts = self.of_pieces(low, at, size)
        n_ids = np.bincount(owner[at], counts, n).astype(np.int64)
        if simple.all():
            return ids, n_ids
        # The other words' ids go in between.
        odd = np.flatnonzero(~simple)
        got = [self._other(w) for w in words.take(pa.array(odd)).to_pylist()]
        begin = np.cumsum(n_ids) - n_ids
        n_ids[odd] = [len(g) // 4 for g in got]
        begin[odd] = len(ids) + np.cumsum(n_ids[odd]) - n_ids[odd]
        take, _ = _ragged(begin, n_ids)
        return np.concatenate([ids, np.frombuffer(b"".join(got), np.uint32)])[take], n_ids

    def of_texts(self, texts: pa.Array, end: int) -> Iterator[bytes]:
        """The ids of each text with end, as little-endian unsigned 32-bit numbers; null counts as empty."""
        last = array("I", [end]).tobytes()
        if self.merges is None:
            for text in texts.to_pylist():
                yield self._whole(text or "") + last
            return
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = words.flatten().dictionary_encode()
        ids, sizes = self.of_words(numbered.dictionary)
        which = numbered.indices.to_numpy()
        take, ends = _ragged((np.cumsum(sizes) - sizes)[which], sizes[which])
        flat = ids[take]
        # An array's slice has offsets into the words before it, too.
        offsets = words.offsets.to_numpy()
        bounds = ends[offsets - offsets[0]]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[a:b].tobytes() + last
