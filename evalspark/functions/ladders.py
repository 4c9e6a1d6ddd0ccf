"""Answers found by ordered rules: the first rule that a response follows says what it answered.

A rule is a phrase and its answer. A phrase stands anywhere in the response; `^` before it holds it to the beginning, `$`
behind it to the end, and `~` before it makes it a regular expression. Long tables are parameters: a ladder takes any
list of rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import let

Rules = Sequence[tuple[str, int]]

# Phrases of yes and no (in pairs, no first), and of two puzzles, in the order in which they count.
_FRAMES = (
    ("answer is {}", "no", "yes"), ("the answer {}", "no", "yes"), ("final answer {}", "no", "yes"), ("i would answer {}", "no", "yes"), ("the answer is without any modification {}", "no", "yes"),
    ("the answer to the question is {}", "no", "yes"), ("the answer is {}", "false", "true"), ("answer {}", "false", "true"), ("the answer is $\\boxed{{\\text{{{}}}}}$", "false", "true"), ("the answer is \\boxed{{{}}}", "no", "yes"),
    ("the answer is \\boxed{{\\text{{{}}}}}", "false", "true"), ("the answer is \\boxed{{\\text{{{}}}}}", "no", "yes"), ("i will provide the answer as {}", "no", "yes"), ("prefix answer {}", "no", "yes"), ("conclusion {}", "no", "yes"),
)
YES_NO: Rules = tuple((frame.format(word), k) for frame, *pair in _FRAMES for k, word in enumerate(pair))
ENDS: Rules = (("^no", 0), ("^yes", 1), ("no$", 0), ("yes$", 1))
LIES: Rules = (
    *YES_NO, ("the prefix no applies to the statement", 0), ("veena s statement cannot be true", 0), ("therefore truly lorene tells the truth", 1), ("the answer is the truth", 1), ("affirmatively alejandro tells the truth", 1),
    ("~answer is (.+?) tells a lie", 0), ("~answer is (.+?) lies", 0), ("~answer is (.+?) says lie", 0), ("~answer is (.+?) doesn t tell the truth", 0), ("~answer is (.+?) does not tell the truth", 0), ("~answer is (.+?) didn t tell the truth", 0),
    ("~answer is (.+?) tells the truth", 1), ("~answer is (.+?) does tell the truth", 1), ("~answer to the question (.+?) is no", 0), ("~answer to the question (.+?) is yes", 1), ("~from the above steps we can conclude that (.+?) tells the truth", 1),
    ("does not tell the truth$", 0), ("cannot be telling the truth$", 0), ("is lying$", 0), ("tells the lie$", 0), ("is also telling the truth$", 1), ("must be lying$", 1), ("must be telling the truth$", 1), ("tells the truth$", 1),
    ("delfina does tell the truth$", 1), ("osvaldo is telling the truth$", 1), ("lies$", 0), *ENDS,
)
NAVIGATE: Rules = (
    *YES_NO, ("you do not return to the starting point", 0), ("you are not at the starting point", 0), ("you haven t moved back to the starting point", 0), ("you cannot return to the starting point", 0), ("you return to the starting point", 1),
    ("you are not facing the starting point", 0), ("you haven t returned to the starting point", 0), ("you end up back at the starting point", 1), ("you are not back at the starting point", 0), ("you will not return to the starting point", 0),
    ("yes following these instructions", 1), ("we end up back at the starting point", 1), ("indeed returns us to the starting point", 1), ("indeed bring us back to the starting point", 1), ("you ll end up right back where you started", 1),
    ("we ve now returned to the starting point", 1), ("i have returned to the starting position", 1), ("the final position is not directly at the starting point", 0), ("it appears that we did not return to the exact starting point", 0),
    ("does not return us to the starting point", 0), ("i will end up back where i started", 1), ("indeed return to the starting point", 1), ("i ll be back where i started", 1), ("i ll end up back at the starting point", 1),
    ("after following these instructions we return to the starting point", 1), ("we are back at the starting point!", 1), ("we are now back at the starting point", 1), ("you ll end up back where you started", 1), ("we have now returned to the starting point", 1),
    ("i ve returned to the starting point", 1), ("following these instructions will always return us to the starting point", 1), ("indeed return you to the starting point", 1), ("the answer is the starting point", 1),
    ("following these instructions doesn t return us to the starting point", 0), ("following these directions does not lead you back to your original starting point", 0), *ENDS,
)
LABELS = {"yes": 1, "no": 0, "(a)": 0, "(b)": 1}


def plain(response: Column) -> Column:
    """A response in lower case without turn marks, some punctuation as blanks, squeezed."""
    t = F.trim(F.regexp_replace(F.lower(response), r"<\|user\|>\z", ""))
    t = F.replace(F.regexp_replace(t, r"\A<[123]>", ""), F.lit("<|turn_end|>"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(t, '[:"\\-,.：]|\\*\\*', " "), r"(?U)\s+", " "))


def follows(response: Column, phrase: str) -> Column:
    if phrase.startswith("~"):
        return response.rlike(phrase[1:])
    if phrase.startswith("^"):
        return response.startswith(phrase[1:])
    # a sign at the end of a formula is no anchor
    if phrase.endswith("$") and not phrase.endswith("}$"):
        return response.endswith(phrase[:-1])
    return F.contains(response, F.lit(phrase))


def answered(response: Column, rules: Rules) -> Column:
    """The answer of the first rule that the response, made plain, follows; null if it follows none."""
    return let(plain(response), lambda t: F.coalesce(*[F.when(follows(t, phrase), F.lit(answer)) for phrase, answer in rules], F.lit(None).cast("int")))


def puzzle_scores(response: Column, label: Column, task: Column, ladders: Mapping[str, Rules]) -> dict[str, Column]:
    """match, extracted and extract_fail of responses to tasks whose name holds a ladder's key; the first such ladder
    counts, and a task without one has null everywhere."""
    found, known = F.lit(None).cast("int"), F.lit(False)
    for key, rules in reversed(ladders.items()):
        found = F.when(F.contains(task, F.lit(key)), answered(response, rules)).otherwise(found)
        known = known | F.contains(task, F.lit(key))
    wanted = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])[F.lower(label)]
    return {"match": F.when(known, F.coalesce(found == wanted, F.lit(False)).cast("int")), "extracted": found, "extract_fail": F.when(known, found.isNull().cast("int"))}


def ensemble(*parts: Mapping[str, Column]) -> dict[str, Column]:
    """The outputs of several evaluators as one; of those of one name, the last counts."""
    return {name: c for part in parts for name, c in part.items()}


def split_track(match: Column, judged: Column, subset: Column, track: Column | None = None) -> dict[str, Column]:
    """Short answers and open ones apart: qa_track, match, skipped. A subset of single rounds, or one called open, is open
    unless the row names its track; an open answer matches from a judge's 3 on, and without a judgement it is skipped."""
    s = F.coalesce(subset, F.lit(""))
    is_open = F.contains(s, F.lit("single_round")) | s.isin("open", "open_ended")
    own = F.nullif(track, F.lit("")) if track is not None else F.lit(None).cast("string")
    name = F.coalesce(own, F.when(is_open, "open").otherwise("short"))
    short = name == "short"
    return {"qa_track": name, "match": F.when(short, match).otherwise(F.coalesce((judged >= 3).cast("int"), F.lit(0))), "skipped": F.when(short, F.lit(None).cast("int")).otherwise(judged.isNull().cast("int"))}
