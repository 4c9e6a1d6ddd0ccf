"""Operator 9, word-first language identification with character backoff.

Training counts words per language, and character n-grams of those words. A text's words are looked up first: a known
word scores by its log frequency in each language. An unseen word falls back to its n-grams of four characters, then
three, two and one, taking the longest length of which any is known. Scores are averaged over the words of the whole
text; the most likely language wins, ties by name.

The model is fitted on a bounded sample of labelled documents (TRAIN_DOCS whole texts, chosen by hash); all words and
n-grams that the sample holds LEAST_COUNT times are in it, and the sample bounds it, so it is broadcast. Texts are
scored where they are: no shuffle.

A word is a run of letters and of the few number signs that stand among them (as in x²); a run without any letter
(½, ², Ⅷ) is none.

Defined cases: a null text and one without letters are `und` with score 0; without any labelled document every
prediction is `und`; null languages are never learned; rows that repeat an id are predicted each, and a null id counts
as the empty text; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample, in documents.
TRAIN_DOCS = 12_000
GRAM_LENGTHS = (4, 3, 2, 1)
#: A word or n-gram seen less often in training counts as unseen.
LEAST_COUNT = 3
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores a worker keeps.
_KEPT = 300_000


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    found = _RUNS.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """About `most` rows of (doc_id, text, lang) by a hash of the id; all of them where there are no more."""
    n = labelled.count()
    share = min(1.0, most / max(n, 1))
    return labelled if share >= 1 else labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _counts(sample: DataFrame) -> DataFrame:
    """(lang, length, gram, n): words have length 0, n-grams of words (with word ends) their own length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in found.items():
            grams: Counter = Counter()
            for word, n in words.items():
                w = f"<{word}>"
                for length in GRAM_LENGTHS:
                    for k in range(len(w) - length + 1):
                        grams[length, w[k : k + length]] += n
            rows = [(lang, 0, w, n) for w, n in words.items()] + [(lang, length, g, n) for (length, g), n in grams.items()]
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50_000], strict=True)], names=["lang", "length", "gram", "n"])

    partial = sample.select("lang", "text").mapInArrow(count, "lang string, length long, gram string, n long")
    return partial.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Per length a table of grams and their log frequency in each language."""

    def __init__(self, rows: list, langs: list[str]):
        self.langs = langs
        at = {lang: k for k, lang in enumerate(langs)}
        self.index: dict[int, dict[str, int]] = {}
        self.scores: dict[int, np.ndarray] = {}
        for length in (0, *GRAM_LENGTHS):
            grams = sorted({r["gram"] for r in rows if r["length"] == length})
            index = {g: k for k, g in enumerate(grams)}
            n = np.full((len(grams), len(langs)), 0.5)
            for r in rows:
                if r["length"] == length:
                    n[index[r["gram"]], at[r["lang"]]] += r["n"]
            self.index[length], self.scores[length] = index, np.log(n / n.sum(axis=0, keepdims=True)) if len(grams) else n

    def unseen(self, word: str) -> np.ndarray:
        """The scores of an unseen word by its n-grams of the longest length that is known."""
        w = f"<{word}>"
        for length in GRAM_LENGTHS:
            index = self.index[length]
            known = [k for k in (index.get(w[i : i + length]) for i in range(len(w) - length + 1)) if k is not None]
            if known:
                return self.scores[length][known].mean(axis=0)
        return np.zeros(len(self.langs))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of docs (doc_id, text, lang), all of which may be learned from; None without labelled rows."""
    counts = _counts(_sample(docs.filter("lang is not null").select("doc_id", "text", "lang"), train_docs))
    # one row per gram, in one pass; what a bounded sample holds is bounded
    grams = counts.groupBy("length", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    rows = grams.filter(F.col("total") >= LEAST_COUNT).select("length", "gram", F.inline("by")).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in rows})
    return Model(rows, langs) if langs else None


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        words = dict(m.index[0]) if m else {}
        known = len(words)
        # rows of unseen words follow those of the model
        matrix = np.concatenate((m.scores[0], np.empty((_KEPT, len(m.langs))))) if m else None
        for batch in batches:
            langs, scores = [], []
            for t in batch.column("text"):
                found = words_of(t.as_py())
                if not found or m is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at = list(map(words.get, found))
                if None in at:
                    new = {w for w, k in zip(found, at, strict=True) if k is None}
                    if len(words) + len(new) > len(matrix):
                        words, new = dict(m.index[0]), set(found) - m.index[0].keys()
                        if known + len(new) > len(matrix):
                            matrix = np.concatenate((m.scores[0], np.empty((len(new), len(m.langs)))))
                    for w in new:
                        matrix[len(words)] = m.unseen(w)
                        words[w] = len(words)
                    at = list(map(words.get, found))
                mean = matrix[at].mean(axis=0)
                best = int(np.argmax(mean))
                # the evidence of up to twenty words, as a probability
                p = np.exp((mean - mean[best]) * min(len(found), 20))
                langs.append(m.langs[best])
                scores.append(float(1 / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return kept.mapInArrow(score, "doc_id long, lang_pred string, score double")
