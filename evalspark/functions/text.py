"""Text functions as Columns: normalisation, tokens, judge parsers. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nz(c: Column) -> Column:
    """None and the empty string are both missing."""
    return F.when(c != "", c)


def first_present(*columns: Column) -> Column:
    """The first value that is not missing."""
    return F.coalesce(*[nz(c) for c in columns])


def words(text: Column) -> Column:
    """White-space separated words; a missing text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """No white space at the ends, of any script's kind."""
    return F.regexp_replace(text, "(?U)\\A\\s+|\\s+\\z", "")


def squeeze(text: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normalize_basic(text: Column) -> Column:
    """Lower case, bracketed parts dropped, marks, symbols and punctuation to blanks, squeezed."""
    bare = F.regexp_replace(F.lower(text), "\\[[^\\]]*\\]|<[^>]*>|\\([^)]*\\)", "")
    return squeeze(F.regexp_replace(bare, "[\\p{M}\\p{S}\\p{P}]", " "))


def normalize_qa(text: Column) -> Column:
    """Lower case, ASCII punctuation and articles dropped, squeezed."""
    plain = F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", "")
    return F.array_join(F.filter(words(plain), lambda w: ~w.isin("a", "an", "the")), " ")


def tokens(text: Column) -> Column:
    """Characters where the text has any CJK character, words otherwise."""
    chars = F.filter(F.split(text, ""), lambda c: F.trim(c) != "")
    return F.when(text.rlike(CJK), chars).otherwise(words(text))


def f1(common: Column, n_predicted: Column, n_reference: Column) -> Column:
    """F1 of counts; both empty is 1."""
    score = F.coalesce(F.try_divide(2.0 * common, (n_predicted + n_reference).cast("double")), F.lit(0.0))
    return F.when((n_predicted == 0) & (n_reference == 0), F.lit(1.0)).otherwise(score)


def caption(text: Column) -> Column:
    """The first sentence, of up to 64 words."""
    sentence = F.element_at(F.split(F.trim(text), "(?<=[.!?])\\s+", 2), 1)
    return F.array_join(F.slice(words(sentence), 1, 64), " ")


def rating(text: Column) -> Column:
    """A judge's `[[n]]`, else the last number from 1 to 5."""
    marked = nz(F.regexp_extract(text, "\\[\\[(\\d+(?:\\.\\d+)?)\\]\\]", 1))
    numbers = F.regexp_extract_all(text, F.lit("\\b([1-5](?:\\.\\d+)?)\\b"), 1)
    return F.coalesce(marked, F.try_element_at(numbers, F.lit(-1))).cast("double")


def yes_no(text: Column, ascii_bounds: bool = False) -> Column:
    """1 for the last `yes`, 0 for the last `no`, null for neither. Words end at whatever is no letter, figure or _, of any
    script or, with ascii_bounds, of ASCII alone."""
    pattern = "(?<![A-Za-z0-9_])(yes|no)(?![A-Za-z0-9_])" if ascii_bounds else "\\b(yes|no)\\b"
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), 1)
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last == "yes", 1).when(last == "no", 0)
