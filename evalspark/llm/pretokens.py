"""Pre-tokens of many texts at once: byte ranges found by array operations, and tables keyed by their bytes.

Two split patterns are known here, both of which class characters as blanks, letters, numbers and others:

- joined: `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`
- words: `'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+` with white space dropped and A-Z lowered

A run of characters without white space that holds one beyond U+024F is one piece here, for the library to split: white
space is a boundary in both patterns. So is a whole text that holds white space about which libraries disagree, or `<|`,
with which special tokens begin.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from evalspark.llm.shared import _BASE, _LOW_BYTES, _LOWER, mix64

BLANK, LETTER, NUMBER, OTHER, FAR = range(5)
PLAIN, LIBRARY, TEXT = range(3)
#: Code points up to here are classed here; those beyond are FAR. U+0130 changes its class when it is lowered.
LAST = 0x24F
_DOTTED = 0x130
#: Bytes of texts that are split together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Pieces up to this many bytes have keys of two numbers and are looked up as arrays.
KEY_BYTES = 16


def _class(point: int) -> int:
    if point == 32 or 9 <= point <= 13:
        return BLANK
    kind = unicodedata.category(chr(point))[0]
    return FAR if point == _DOTTED else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


_POINT_CLASS = np.array([_class(p) for p in range(LAST + 1)] + [FAR] * (0x800 - LAST - 1), dtype=np.uint8)
_BYTE_CLASS = np.concatenate((_POINT_CLASS[:128], np.full(128, FAR, dtype=np.uint8)))
#: What makes a text one piece, as UTF-8: control characters that some call white space, and Unicode's white space.
_UNSURE_2 = np.array([0xC285, 0xC2A0])
_UNSURE_3 = np.array([0xE19A80, 0xE1A08E, *range(0xE28080, 0xE28090), *range(0xE280A8, 0xE280B0), 0xE2819F, 0xE38080, 0xEFBBBF])


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, where each text starts and the last one ends); a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    k = 0
    while k < len(texts):
        upto = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK_BYTES, side="right")) - 1)
        yield k, upto, raw[bounds[k] : bounds[upto]], bounds[k : upto + 1] - bounds[k]
        k = upto


def _unsure(raw: np.ndarray) -> np.ndarray:
    """Places (bytes) of what makes a text one piece."""
    n = len(raw)
    control = np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))
    mark = np.flatnonzero(raw == ord("<"))
    mark = mark[(mark + 1 < n) & (raw[np.minimum(mark + 1, n - 1)] == ord("|"))]
    lead = np.flatnonzero(raw >= 0xC2)
    wide = raw[lead].astype(np.int64)
    two = wide << 8 | raw[np.minimum(lead + 1, n - 1)]
    three = two << 8 | raw[np.minimum(lead + 2, n - 1)]
    white = lead[np.isin(two, _UNSURE_2) | np.isin(three, _UNSURE_3)] if len(lead) else lead
    return np.concatenate((control, mark, white))


def split(raw: np.ndarray, starts: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lowered for words), where each pre-token begins and ends, and what it is (PLAIN, LIBRARY's to split, or a
    whole TEXT), of the texts raw[starts[k]:starts[k + 1]]."""
    n = len(raw)
    if not n:
        return raw, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint8)
    if words:
        raw = _LOWER[raw]
    kind = _BYTE_CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC9))
    if len(lead):
        point = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F
        kind[lead] = kind[lead + 1] = _POINT_CLASS[point]
    head = np.zeros(n + 3, dtype=bool)
    head[starts] = True
    head[n:] = True
    blank = kind == BLANK
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= head[:n]
    if words:
        number = np.flatnonzero(kind == NUMBER)
        first[number[raw[number] & 0xC0 != 0x80]] = True
    else:
        # the last blank before other characters stands alone, or with them if it is a space
        after = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        after = after[~head[after]]
        first[after - 1] = True
        first[after] = raw[after - 1] != 32
    far = np.flatnonzero(kind == FAR)
    if len(far):
        # the run without blanks around each, with the space that a joined pattern adds to it
        opens = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])) | ~blank & head[:n])
        closes = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])) | ~blank & head[1 : n + 1]) + 1
        run = np.unique(np.searchsorted(opens, far, side="right") - 1)
        for a, b in zip(opens[run].tolist(), closes[run].tolist(), strict=True):
            first[a + 1 : b] = False
            kind[a:b] = FAR
    quote = np.flatnonzero((raw == 39) & first & (kind == OTHER))
    if len(quote):
        padded = np.concatenate((raw, np.zeros(2, dtype=np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)) & ~head[quote + 1]
        long = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & ~head[quote + 1] & ~head[quote + 2]
        first[quote[short | long] + 1] = False
        end = np.concatenate((quote[short] + 2, quote[long] + 3))
        first[end[end < n]] = True
    unsure = _unsure(raw)
    whole = np.zeros(n, dtype=bool)
    if len(unsure):
        for k in np.unique(np.searchsorted(starts, unsure, side="right") - 1).tolist():
            first[starts[k] + 1 : starts[k + 1]] = False
            whole[starts[k]] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    if words:
        keep = ~blank[begin] | whole[begin]
        begin, end = begin[keep], end[keep]
    return raw, begin, end, np.where(whole[begin], TEXT, np.where(kind[end - 1] == FAR, LIBRARY, PLAIN)).astype(np.uint8)


def keys(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that are, with the size, a piece of up to KEY_BYTES bytes."""
    padded = np.concatenate((raw, np.zeros(KEY_BYTES, dtype=np.uint8)))
    eight = np.ndarray((len(raw) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    return eight[begin] & _LOW_BYTES[np.minimum(size, 8)], eight[begin + 8] & _LOW_BYTES[np.clip(size - 8, 0, 8)]


class PieceTable:
    """Numbers by piece, open addressing at a load of one half at most: 21 bytes a slot, and no piece is mistaken for
    another, as keys hold all bytes."""

    def __init__(self, pieces: int):
        bits = max(10, int(2 * pieces - 1).bit_length())
        self.mask, self.most, self.held = np.uint64((1 << bits) - 1), 1 << (bits - 1), 0
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.size, self.value = np.zeros(1 << bits, dtype=np.uint8), np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64(low ^ mix64(high ^ size.astype(np.uint64) * _BASE)) & self.mask

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for one that isn't held."""
        out = np.full(len(low), -1, dtype=np.int64)
        slot, left = self._slot(low, high, size), None
        while True:
            here = self.size[slot]
            same = (here == size) & (self.low[slot] == low) & (self.high[slot] == high)
            if left is None:
                out[same] = self.value[slot[same]]
            else:
                out[left[same]] = self.value[slot[same]]
            more = np.flatnonzero(~same & (here != 0))
            if not len(more):
                return out
            left = more if left is None else left[more]
            low, high, size, slot = low[more], high[more], size[more], slot[more] + np.uint64(1) & self.mask

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, value: np.ndarray) -> None:
        """Holds more pieces, which must differ and not be held yet; there must be room."""
        slot, left = self._slot(low, high, size), np.arange(len(low))
        self.held += len(low)
        while len(left):
            free = self.size[slot[left]] == 0
            # where several want one free slot, the first has it
            at, won = np.unique(slot[left[free]], return_index=True)
            here = left[free][won]
            self.low[at], self.high[at], self.size[at], self.value[at] = low[here], high[here], size[here], value[here]
            left = np.setdiff1d(left, here, assume_unique=True)
            slot[left] = slot[left] + np.uint64(1) & self.mask

    def room(self) -> int:
        """How many more pieces it can hold."""
        return max(0, self.most - self.held)
