"""Text functions that native Columns are too slow for, as Arrow functions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, exactly: a bit per token of b, one step per token of a."""
    places: dict[str, int] = {}
    for k, token in enumerate(b):
        places[token] = places.get(token, 0) | 1 << k
    full = (1 << len(b)) - 1
    state = full
    for token in a:
        hit = state & places.get(token, 0)
        state = (state + hit | state - hit) & full
    return len(b) - state.bit_count()


#: Bytes of a column's texts that become Python objects, or numbers of words, at once.
CHUNK_BYTES = 1 << 20


def chunks(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Columns of one length in slices of about CHUNK_BYTES each, a row at least, so that what a batch of rows takes
    doesn't hang on how many rows or how long texts it has."""
    start, n = 0, len(columns[0])
    rows = max(1, min(n, CHUNK_BYTES * n // max(1, *(c.nbytes for c in columns))))
    while start < n:
        part = [c.slice(start, rows) for c in columns]
        # rows differ in length
        if len(part[0]) > 1 and max(c.nbytes for c in part) > 2 * CHUNK_BYTES:
            rows = max(1, len(part[0]) // 2)
            continue
        yield part
        start += len(part[0])


@F.arrow_udf(returnType=LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """lcs of two columns of arrays."""
    return pa.array([lcs(x, y) for p, q in chunks(a, b) for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.int64())


def edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance, exactly: a bit per token of a, one step per token of b."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for token in b:
        same = places.get(token, 0)
        straight = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(straight | up) & full, up & straight
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 & full | 1
        up, down = fall << 1 & full | ~(straight | rise) & full, rise & straight
    return distance


@F.arrow_udf(returnType=LongType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """edits of two columns of arrays, of any length and vocabulary."""
    return pa.array([edits(x or [], y or []) for p, q in chunks(a, b) for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.int64())


@F.arrow_udf(returnType=LongType())
def common_count(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of the multiset intersections of two columns of arrays."""
    return pa.array([(Counter(x or []) & Counter(y or [])).total() for p, q in chunks(a, b) for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.int64())


@F.arrow_udf(returnType=StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode normal form NFKC."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(returnType=StringType())
def nfd(text: pa.Array) -> pa.Array:
    """Unicode normal form NFD."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFD", t) for t in text.to_pylist()], pa.string())


#: Letters that no decomposition maps to ASCII (fixed values).
LETTERS = str.maketrans({"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"})


@F.arrow_udf(returnType=StringType())
def unmarked(text: pa.Array) -> pa.Array:
    """Letters without their diacritics (NFKD)."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.translate(LETTERS)) if unicodedata.category(c) != "Mn")
    return pa.array([t if t is None or t.isascii() else plain(t) for t in text.to_pylist()], pa.string())


_COUNTS = StructType([StructField(f"{s}{n}", LongType()) for n in range(1, 7) for s in "mhr"])


def _gram_counts(hypothesis: Sequence[str], reference: Sequence[str], most: int) -> dict[str, int]:
    out = {}
    for n in range(1, 7):
        h, r = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) if n <= most else Counter() for x in (hypothesis, reference))
        out |= {f"m{n}": (h & r).total(), f"h{n}": h.total(), f"r{n}": r.total()}
    return out


_COUNT_TYPE = pa.struct([(f"{s}{n}", pa.int64()) for n in range(1, 7) for s in "mhr"])


@F.arrow_udf(returnType=_COUNTS)
def word_gram_counts(hypothesis: pa.Array, reference: pa.Array) -> pa.Array:
    """Of n-grams of up to four tokens: clipped matches m, and how many there are in the hypothesis h and reference r."""
    return pa.array([_gram_counts(h or [], r or [], 4) for p, q in chunks(hypothesis, reference) for h, r in zip(p.to_pylist(), q.to_pylist(), strict=True)], _COUNT_TYPE)


@F.arrow_udf(returnType=_COUNTS)
def char_gram_counts(hypothesis: pa.Array, reference: pa.Array) -> pa.Array:
    """The same of n-grams of up to six characters, white space left out."""
    bare = lambda t: "".join((t or "").split())
    return pa.array([_gram_counts(bare(h), bare(r), 6) for p, q in chunks(hypothesis, reference) for h, r in zip(p.to_pylist(), q.to_pylist(), strict=True)], _COUNT_TYPE)


def _numbered(values: pa.Array | np.ndarray) -> np.ndarray:
    """Equal values by one number, in the order in which they first stand."""
    return pa.array(values).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def word_codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column of texts the row and the number of every word between ASCII white space, in order; equal words have
    one number in all columns."""
    out, words = [], []
    for texts in columns:
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = pc.list_flatten(lists)
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        full = pc.not_equal(flat, "")
        words.append(flat.filter(full))
        out.append(rows[full.to_numpy(zero_copy_only=False)])
    codes = _numbered(pa.concat_arrays(words))
    bounds = np.cumsum([0, *map(len, words)])
    return [(rows, codes[a:b]) for rows, a, b in zip(out, bounds[:-1], bounds[1:], strict=True)]


@F.arrow_udf(returnType=StructType([StructField(c, LongType()) for c in ("common", "n_a", "n_b")]))
def common_words(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words that two texts share, as multisets, and how many each has."""
    none = pa.array([], pa.int64())
    return pa.concat_arrays([pa.StructArray.from_arrays([none] * 3, names=["common", "n_a", "n_b"]), *[_common(p, q) for p, q in chunks(a, b)]])


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    n, sides = len(a), word_codes(a, b)
    (x, n_x), (y, n_y) = (np.unique(rows << 32 | codes, return_counts=True) for rows, codes in sides)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = np.bincount(both >> 32, weights=np.minimum(n_x[i], n_y[j]), minlength=n).astype(np.int64)
    sizes = [np.bincount(rows, minlength=n).astype(np.int64) for rows, _ in sides]
    return pa.StructArray.from_arrays([pa.array(c) for c in (common, *sizes)], names=["common", "n_a", "n_b"])


@F.arrow_udf(returnType=DoubleType())
def repeated_share(text: pa.Array) -> pa.Array:
    """1 minus the share of distinct runs of four words; 0 for fewer words."""
    return pa.concat_arrays([pa.array([], pa.float64()), *[_repeated(part) for (part,) in chunks(text)]])


def _repeated(text: pa.Array) -> pa.Array:
    ((rows, codes),) = word_codes(text)
    # pairs of words, then pairs of pairs, by their numbers among all pairs: these stay small and are exact
    for step in (1, 2):
        codes = _numbered(codes[:-step] << 32 | codes[step:]) if len(codes) > step else codes[:0]
    inside = rows[:-3] == rows[3:]
    runs = np.bincount(rows[:-3][inside], minlength=len(text))
    distinct = np.bincount(pc.unique(pa.array(rows[:-3][inside] << 32 | codes[inside])).to_numpy() >> 32, minlength=len(text))
    return pa.array(np.where(runs > 0, 1 - distinct / np.maximum(runs, 1), 0.0))


_CJK = re.compile("[\u4e00-\u9fff]")


def _normal(text: str | None) -> str:
    """NFKC, lower case, punctuation to blanks, squeezed."""
    t = unicodedata.normalize("NFKC", text or "").lower()
    bare = "".join(" " if unicodedata.category(c)[0] == "P" or c in string.punctuation else c for c in t)
    return " ".join(bare.split())


def _tokens(text: str) -> list[str]:
    """Characters where any is CJK, words otherwise."""
    return [c for c in text if not c.isspace()] if _CJK.search(text) else text.split()


def best_scores(predicted: str | None, references: Sequence[str | None]) -> dict[str, float]:
    """The best token F1, exact match and LCS F1 of a text against any of its references; without one, those of the empty
    text."""
    p = _normal(predicted)
    a, best = _tokens(p), {"text_f1": 0.0, "exact_match": 0.0, "rouge_l": 0.0}
    for r in map(_normal, references or [""]):
        b = _tokens(r)
        share = lambda n: 1.0 if not a and not b else 2 * n / (len(a) + len(b))  # noqa: B023, E731
        scores = {"text_f1": share((Counter(a) & Counter(b)).total()), "exact_match": float(p == r), "rouge_l": share(lcs(a, b))}
        best = {k: max(v, scores[k]) for k, v in best.items()}
    return best


_BEST = ("text_f1", "exact_match", "rouge_l")


@F.arrow_udf(returnType=StructType([StructField(c, DoubleType()) for c in _BEST]))
def best_of(predicted: pa.Array, references: pa.Array) -> pa.Array:
    """best_scores of a column of texts and one of arrays of references."""
    kind = pa.struct([(c, pa.float64()) for c in _BEST])
    return pa.array([best_scores(p, r) for x, y in chunks(predicted, references) for p, r in zip(x.to_pylist(), y.to_pylist(), strict=True)], kind)
