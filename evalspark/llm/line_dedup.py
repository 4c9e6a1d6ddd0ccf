"""Operator 2, line dedup: repeated windows of three lines, across and within documents.

Lines with a word, white space at their ends stripped, are counted within a document. Every three consecutive ones
make a window, hashed to 128 bits. Of equal windows the first by (document id, text's hash, place) stays; each later
one covers its three lines, and the union of what is covered is removed.

Shape: one row per window is shuffled by hash to count and to find first places (combined on the map side, so a
window that a third of all documents hold is one row per task), the repeated ones are joined back by hash (a plain
sort-merge join, whose skewed partitions adaptive execution splits), and the covered line numbers are joined to the
texts by document id and text hash.

Defined cases: a null text stays null and has no lines; the empty text and texts of fewer than three lines with words
have no windows and stay as they are; blank lines are never removed unless all lines with words are, in which case
the text becomes empty; rows that repeat a document id and text are one document (they lose the same lines, and none
of them for being repeated); rows of one id and different texts are documents of their own; a null id is an id, the
first; an empty table gives an empty table; further columns pass through whatever their names, and n_chars, where
there is one, is set anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import BLANKS, fresh

WIDTH = 3
_ENDS = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, BLANKS, "")) > 0


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per window: doc_id, key (hash of the text), at (number of its first line among lines with words, from 0),
    h1 and h2."""
    stripped = F.transform(F.split(F.coalesce(docs[text], F.lit("")), "\n"), lambda x: F.regexp_replace(x, _ENDS, ""))
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("key"), F.filter(stripped, lambda x: x != "").alias("lines"))
    line = lambda i, k: F.get("lines", i + k)
    window = lambda i: F.struct(
        i.alias("at"),
        F.xxhash64(*[line(i, k) for k in range(WIDTH)]).alias("h1"),
        F.xxhash64(F.lit(WIDTH), *[line(i, k) for k in reversed(range(WIDTH))]).alias("h2"),
    )
    starts = F.sequence(F.lit(0), F.size("lines") - WIDTH)
    rows = rows.filter(F.size("lines") >= WIDTH)
    return rows.select("doc_id", "key", F.inline(F.transform(starts, window)))


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document that loses lines: doc_id, key and the sorted numbers of those lines."""
    each = windows(docs, doc_id, text)
    place = F.struct("doc_id", "key", "at")
    firsts = each.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # a window that occurs at one place only is not repeated, however many rows have it
    repeated = firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    later = each.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    lines = later.select("doc_id", "key", F.explode(F.sequence(F.col("at"), F.col("at") + WIDTH - 1)).alias("line"))
    return lines.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias("covered"))


def _kept_text(text: Column, covered: Column) -> Column:
    """The text without its covered lines; empty where no line with a word stays."""
    lines = F.split(text, "\n")
    solid = F.transform(lines, lambda x: _has_word(x).cast("int"))
    # the number of each line among lines with words: places of solid lines, found by position
    places = F.filter(F.transform(solid, lambda v, i: F.when(v == 1, i).otherwise(-1)), lambda i: i >= 0)

    def without(p: Column) -> Column:
        gone = F.transform(covered, lambda c: F.get(p, c))
        # array_except hashes and keeps the order of what is left
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.when(F.size(covered) >= F.size(p), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))

    return F.element_at(F.transform(F.array(places), without), 1)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """docs without the lines of later occurrences; `removed` names a column for the removed line numbers."""
    of, key, covered = fresh(docs.columns, "_doc", "_key", "_covered")
    found = covered_lines(docs, doc_id, text).select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("covered").alias(covered))
    joined = docs.join(found, docs[doc_id].eqNullSafe(found[of]) & (F.xxhash64(docs[text]) == found[key]), "left")
    same = F.col(covered).isNull()
    new = F.when(same, docs[text]).otherwise(_kept_text(docs[text], F.col(covered)))
    out = joined.select(*[new.alias(c) if c == text else docs[c] for c in docs.columns], covered)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    if removed:
        out = out.withColumn(removed, F.coalesce(F.col(covered), F.array().cast("array<int>")))
    return out.drop(covered)
