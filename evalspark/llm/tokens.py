"""Token ids of whole texts by a public tokenizer file, whole Arrow columns at a time.

Texts are split into pre-tokens by array operations (pretokens), each distinct pre-token is encoded once per worker, and
ids are gathered from one pool. A new pre-token goes through the file's own steps one by one (normaliser, byte alphabet,
then the library's BPE model), which skips the costly bookkeeping of a whole encoding. Pieces beyond the Latin scripts,
texts with unusual white space or something like a special token, and all texts of a tokenizer that is not known to
split that way are encoded by the library as they are.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa

from evalspark.llm.pretokens import KEY_BYTES, LIBRARY, PLAIN, TEXT, PieceTable, chunks, keys, split

#: Files known by the SHA-256 of their bytes, and whether their pattern is that of words (fixed values of the files).
_KNOWN = {
    "cec27cb89f428497695f4e2a90118d636a594654897a44c0fb11b8f185521820": False,
    "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a": True,
}
#: Pre-tokens that a worker keeps before it starts anew (about 50 bytes each), and the longest that it keeps.
GENERATION, LONGEST = 1 << 20, 64
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_ALPHABET = _byte_alphabet()
_LETTERS = np.array([ord(_ALPHABET[b]) for b in range(256)], dtype="<u2")


class Encoder:
    """Texts to ids, or to numbers of ids, with the pre-tokens met so far in memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.words = _KNOWN.get(hashlib.file_digest(f, "sha256").hexdigest())
        # the model's own cache would hold a copy of what is kept here
        self.model = self.tokenizer.model
        if self.words is not None:
            self.model._resize_cache(0)
        self.normalise = self.tokenizer.normalizer and self.tokenizer.normalizer.normalize_str
        self._forget()

    def _forget(self) -> None:
        self.table, self.long = PieceTable(GENERATION), {}
        self.pool, self.offsets = array("I"), array("q", [0])

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: bytes, library: bool = False) -> list[int]:
        """The ids of a pre-token."""
        if library:
            return self._whole(piece.decode())
        if self.normalise is not None and not piece.isascii():
            piece = self.normalise(piece.decode()).encode()
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))]

    def _entries(self, source: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, what: np.ndarray) -> np.ndarray:
        """The entry of each piece; new ones are encoded and held. source: the bytes before lowering."""
        size = end - begin
        low, high = keys(raw, begin, size)
        keyed = (size <= KEY_BYTES) & (what != TEXT)
        at = np.flatnonzero(keyed)
        entry = np.full(len(begin), -1, dtype=np.int64)
        entry[at] = self.table.find(low[at], high[at], size[at])
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return entry
        # all bytes as characters of the model's alphabet, so that most pieces are slices of it
        letters = _LETTERS[raw].tobytes().decode("utf-16-le")
        direct = what == PLAIN
        if self.normalise is not None:
            beyond = np.concatenate(([0], np.cumsum(raw >= 0x80)))
            direct &= beyond[end] == beyond[begin]
        seen, fresh, found = {}, [], []
        tokenize, pool, offsets = self.model.tokenize, self.pool, self.offsets
        columns = (missing, begin[missing], end[missing], direct[missing], keyed[missing], what[missing])
        for i, a, b, d, k, w in zip(*(c.tolist() for c in columns), strict=True):
            word = letters[a:b]
            keep = seen if k or b - a > LONGEST else self.long
            held = keep.get(word) if w != TEXT else None
            if held is None:
                if d:
                    pool.extend([t.id for t in tokenize(word)])
                elif w == TEXT:
                    pool.extend(self._whole(source[a:b].tobytes().decode()))
                else:
                    pool.extend(self.piece(raw[a:b].tobytes(), w == LIBRARY))
                held = len(offsets) - 1
                offsets.append(len(pool))
                if w != TEXT:
                    keep[word] = held
                    if k:
                        fresh.append(i)
            found.append(held)
        entry[missing] = found
        fresh = np.array(fresh[: self.table.room()], dtype=np.int64)
        self.table.add(low[fresh], high[fresh], size[fresh], entry[fresh])
        return entry

    def _fresh(self) -> None:
        """Starts anew where the pre-tokens held have become many."""
        if not self.table.room() or len(self.long) > GENERATION or len(self.offsets) > 4 * GENERATION:
            self._forget()

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the last one's end), and all ids as little-endian unsigned 32-bit integers;
        a null text has none."""
        bounds, parts, upto = [np.zeros(1, dtype=np.int64)], [np.empty(0, dtype="<u4")], 0
        if self.words is None:
            each = [self._whole(t) if t else [] for t in texts.to_pylist()]
            return np.concatenate((bounds[0], np.cumsum([len(x) for x in each], dtype=np.int64))), np.array([i for x in each for i in x], dtype="<u4")
        for _, _, source, starts in chunks(texts):
            self._fresh()
            raw, begin, end, what = split(source, starts, self.words)
            entry = self._entries(source, raw, begin, end, what)
            offsets = np.frombuffer(self.offsets, dtype=np.int64)
            first, many = offsets[entry], offsets[entry + 1] - offsets[entry]
            ends = np.concatenate(([0], np.cumsum(many)))
            place = np.repeat(first - ends[:-1], many) + np.arange(ends[-1])
            parts.append(np.frombuffer(self.pool, dtype="<u4")[place] if len(place) else parts[0])
            bounds.append(upto + ends[np.searchsorted(begin, starts[1:])])
            upto += int(ends[-1])
            del offsets
        return np.concatenate(bounds), np.concatenate(parts)

    def counts(self, texts: pa.Array, frequent: PieceTable | None = None) -> np.ndarray:
        """The number of ids of each text; pre-tokens that `frequent` holds are not looked for here."""
        out = np.zeros(len(texts), dtype=np.int64)
        if self.words is None:
            return np.array([len(self._whole(t)) if t else 0 for t in texts.to_pylist()], dtype=np.int64)
        for a, b, source, starts in chunks(texts):
            self._fresh()
            raw, begin, end, what = split(source, starts, self.words)
            many = np.full(len(begin), -1, dtype=np.int64)
            if frequent is not None:
                size = end - begin
                at = np.flatnonzero((size <= KEY_BYTES) & (what != TEXT))
                low, high = keys(raw, begin[at], size[at])
                many[at] = frequent.find(low, high, size[at])
            left = np.flatnonzero(many < 0)
            entry = self._entries(source, raw, begin[left], end[left], what[left])
            offsets = np.frombuffer(self.offsets, dtype=np.int64)
            many[left] = offsets[entry + 1] - offsets[entry]
            del offsets
            ends = np.concatenate(([0], np.cumsum(many)))
            out[a:b] = np.diff(ends[np.searchsorted(begin, starts)])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return self.lists(pa.array([text], pa.large_string()))[1]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
