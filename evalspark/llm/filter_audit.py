"""Operator 11, filter interaction audit: what each of five filters removes, in every order, by part of the corpus.

A document fails some set of the filters, its mask; one scan and one aggregation leave at most 32 masks a part with their
numbers of documents. Everything else follows from those counts, part by part. The game "documents removed by a set of
filters" has the multilinear extension

    v(x_A, ..., x_E) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),

a part's removal polynomial, here by its integer coefficients over the 32 products of variables. At a corner, where each
x is 0 or 1, it counts what that set of filters removes; survivors, steps and overlaps of all 120 orders are differences
of corners. A filter's Shapley value is the integral of its partial derivative along the diagonal, in exact rationals;
120 times that is the sum, over all orders, of what the filter removes.

Filters (words are `[^\\x20\\x09-\\x0D]+`, case-sensitive): A under 100 words; B 100 * distinct words < 80 * words;
C 100 * `[A-Z]` > 10 * code points; D any of `#$%&*|`; E the text is that of a smaller doc_id anywhere in the table.

Equal texts are told by their SHA-256. The smallest id of each digest is found with sums on the map side; rows then meet
it, and their labels, by their own id, which no group of copies shares: a third of all rows being one text makes no hot
key anywhere.

Defined cases: a null text is the empty one; a null part is the empty one; a null doc_id is no smaller than any id and
has no smaller one, so it never fails E, and has no labels; rows that repeat an id count each, and repeat no text by
themselves; of labels that repeat an id, any 1 counts, and null is not 1; very long texts are read whole; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import BLANK_RUN, discard, materialise

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: What is counted by mask: all documents, those of good quality, toxic ones.
_COUNTS = ("n", "good", "toxic")
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: bit k for filter k."""
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")

    def of(words: Column) -> Column:
        n = F.size(words)
        short = F.when(n < LEAST_WORDS, 1).otherwise(0)
        repeats = F.when(100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 2).otherwise(0)
        return short + repeats

    # the words are bound once: a column that is used twice would be split twice
    by_words = F.get(F.transform(F.array(words), of), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = F.when(100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"), 4).otherwise(0)
    return by_words + loud + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): numbers of documents, by part and by the filters that they fail."""
    whole = F.coalesce(docs[text], F.lit(""))
    narrow = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[part], F.lit("")).alias("part"), failures(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    # written once, without texts: both the smallest ids and the rows that meet them are read from it
    rows = materialise(narrow, "audit-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    met = rows.join(marks, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    copied = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    counted = met.groupBy("part", (F.col("mask") + copied).alias("mask"))
    sums = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    counts = materialise(sums, "audit-counts")
    discard(rows)
    return counts


def removal_polynomial(counts: list[int]) -> list[int]:
    """The coefficient of each product of variables (by its mask) in the removal polynomial of counts by mask."""
    coefficients = [0] * len(counts)
    for mask, n in enumerate(counts):
        product = mask
        # 1 - product of (1 - x_i): every nonempty subset of the mask, with the sign of its parity
        while product:
            coefficients[product] += n if product.bit_count() % 2 else -n
            product = product - 1 & mask
    return coefficients


def corners(coefficients: list[int]) -> list[int]:
    """The polynomial's value at each corner: the sum of the coefficients of all products within it."""
    values = list(coefficients)
    for k in range(len(FILTERS)):
        values = [v + values[corner ^ 1 << k] if corner >> k & 1 else v for corner, v in enumerate(values)]
    return values


def shapley_sums(coefficients: list[int]) -> list[int]:
    """Of each filter, the integral of its partial derivative along the diagonal, times the number of orders."""
    sums = []
    for k in range(len(FILTERS)):
        # d/dx_k at (t, ..., t): a product of s variables with x_k leaves t ** (s - 1), whose integral is 1 / s
        integral = sum((Fraction(c, product.bit_count()) for product, c in enumerate(coefficients) if product >> k & 1), Fraction(0))
        total = factorial(len(FILTERS)) * integral
        assert total.denominator == 1
        sums.append(total.numerator)
    return sums


@cache
def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, filters before it as a mask) of all orders."""
    found = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            found.append(("".join(FILTERS[i] for i in order), step, k, before))
            before |= 1 << k
    return found


def part_report(counts: dict[str, list[int]]) -> list[tuple[str, int, int, int, int, int, int, int, int]]:
    """A part's rows: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    polynomials = {c: removal_polynomial(counts[c]) for c in _COUNTS}
    removed = {c: corners(p) for c, p in polynomials.items()}
    shapley, total, every = shapley_sums(polynomials["n"]), sum(counts["n"]), (1 << len(FILTERS)) - 1
    rows = []
    for order, step, k, before in steps():
        after = before | 1 << k
        here, good, toxic = (removed[c][after] - removed[c][before] for c in _COUNTS)
        # those that fail only this filter are what it adds to all others; those that fail it are its own corner
        rows.append((order, step, total - removed["n"][after], here, removed["n"][1 << k] - here, removed["n"][every] - removed["n"][every ^ 1 << k], good, toxic, shapley[k]))
    return rows


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step."""
    counts = mask_counts(docs, labels, doc_id, text, part)
    # at most 32 masks a part
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, masks in zip(batch["part"], batch["masks"], strict=True):
                by_mask = {c: [0] * (1 << len(FILTERS)) for c in _COUNTS}
                for m in masks:
                    for c in _COUNTS:
                        by_mask[c][m["mask"]] = int(m[c])
                rows = pd.DataFrame(part_report(by_mask), columns=[c.split(" ")[0] for c in _RESULT.split(", ")[1:]])
                yield rows.assign(part=name)[["part", *rows.columns]]

    return by_part.mapInPandas(report, _RESULT)
