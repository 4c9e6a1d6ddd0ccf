"""Operator 6, quality rules: a threshold table compiled into one projection of built-in functions.

A rule is a row `(name, measure, least, most)`. Measures are Column expressions over one text; `compile_rules`
turns the table into one boolean Column per rule, so that a text's verdict is one projection without a shuffle,
a join or a user function.

Defined cases: a null text counts as the empty text; the empty text has no words and fails the base rule; rows
keep their number and order of columns, repeated rows get equal verdicts, and other columns are left alone, also
when one of them is called like a measure (measures live in one struct column of a chosen name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import BLANK_RUN, BLANKS

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus' four languages (fixed values).
STOP_WORDS = (
    "the of and to in that is was for with as by on "
    "le la les de des un une et en est que pour dans "
    "der die das und ein eine zu von mit den ist im sich "
    "el los las del y que en un una por con para no"
).split()

#: Stop words as they stand within and at the head of sentences, and words in capitals (letters with case, no lower one).
STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
ALL_CAPITALS = r"^\P{Ll}*\p{Lu}\P{Ll}*$"


@dataclass(frozen=True)
class Rule:
    """A measure's allowed range, both ends included; None leaves an end open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Fewer repeated lines than this are no ground to reject a document; line dedup removes them.
FEW_LINES = 3

#: Production thresholds.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("word_length", "mean_word_chars", least=2.5, most=12.0),
    Rule("symbols", "symbols_per_word", most=0.10),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("capital_words", "capital_ratio", most=0.70),
    Rule("duplicate_lines", "dup_line_ratio", most=0.30),
    Rule("bullet_lines", "bullet_line_ratio", most=0.90),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.30),
    Rule("repeated_words", "repeat_ratio", most=0.50),
)


def _with(value: Column, body) -> Column:
    """body(value), where value is computed once for the row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, first ones included.

    Windows are compared as strings (words hold no blanks, so joining by a blank loses nothing). Only texts in
    which some window repeats pay for the sort that finds the repeated positions.
    """

    def marked(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < last) & (F.get(s, k + 1)["w"] == x["w"])),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        # each repeated window covers its three words, or fewer where the next one begins earlier
        def covered(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            )

        found = _with(_with(ordered, positions), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_with(windows, marked))


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words mean_word_chars symbols_per_word "
    "capital_ratio dup_line_ratio bullet_line_ratio ellipsis_line_ratio repeat_ratio"
).split()


def measures(text: Column) -> Column:
    """A struct of every measure of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def over(words: Column, lines: Column) -> Column:
        n = F.size(words)
        n_lines = F.size(lines)
        word_chars = F.length(F.translate(text, BLANKS, ""))
        n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
        dup_lines = n_lines - F.size(F.array_distinct(lines))
        repeated = _repeat_words(words)
        stop = F.size(F.filter(words, lambda w: w.isin(STOP_FORMS)))
        capital = F.size(F.filter(words, lambda w: (F.length(w) > 1) & w.rlike(ALL_CAPITALS)))
        bullets = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")))
        dots = F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
        ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
        return F.struct(
            n.cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            n_symbols.cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"),
            stop.cast("long").alias("n_stop_words"),
            ratio(word_chars, n).alias("mean_word_chars"),
            ratio(n_symbols, n).alias("symbols_per_word"),
            ratio(capital, n).alias("capital_ratio"),
            F.when(dup_lines >= FEW_LINES, ratio(dup_lines, n_lines)).otherwise(F.lit(0.0)).alias("dup_line_ratio"),
            ratio(bullets, n_lines).alias("bullet_line_ratio"),
            ratio(dots, n_lines).alias("ellipsis_line_ratio"),
            ratio(repeated, n).alias("repeat_ratio"),
        )

    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return _with(F.struct(words.alias("words"), lines.alias("lines")), lambda s: over(s["words"], s["lines"]))


def base_failed(m: Column) -> Column:
    """The base rule: under 50 words, or over half of the words in repeated three-word windows."""
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean Column per rule: true where the measure is in range."""
    out = {}
    for rule in rules:
        value, test = m[rule.measure], F.lit(True)
        if rule.least is not None:
            test = test & (value >= F.lit(rule.least))
        if rule.most is not None:
            test = test & (value <= F.lit(rule.most))
        out[rule.name] = test
    return out


def assessment(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of a text's measures, base_failed, failed (names of failed rules) and kept. It is one expression in
    which the measures are computed once, so a filter on a field of it costs what the struct costs."""
    names = MEASURES

    def judged(m: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compile_rules(m, rules).items()]))
        return F.struct(*[m[c].alias(c) for c in names], base_failed(m).alias("base_failed"), failed.alias("failed"))

    def decided(j: Column) -> Column:
        kept = ~j["base_failed"] & (F.size(j["failed"]) == 0)
        return F.struct(*[j[c].alias(c) for c in (*names, "base_failed", "failed")], kept.alias("kept"))

    return _with(_with(measures(text), judged), decided)


def assess(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """docs with the struct column `into` of their assessment."""
    return docs.withColumn(into, assessment(docs[text], rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs that pass the base rule and all of the table's."""
    return docs.filter(assessment(docs[text], rules)["kept"])
