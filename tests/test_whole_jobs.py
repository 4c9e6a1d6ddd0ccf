"""Small tables on which a job that leaves part of its input out gives other rows."""

import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions import instructions as I
from evalspark.functions import process as P
from evalspark.functions import text_udf as U
from evalspark.plans import queries as plans


def folder(tmp_path, **tables):
    """A scale-factor folder of DataFrames."""
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def distance(r, h):
    row = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        before, row = row, [i]
        for j, y in enumerate(h, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row[-1]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def test_whole_conversations_are_compared(spark, tmp_path):
    rng = random.Random(1)
    some = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    turns = [(c, t, role, some(rng.randrange(30), 12)) for c in range(8) for t, role in enumerate(["system"] * (c % 2) + ["user", "assistant"] * 3)]
    turns += [(8, 0, "assistant", "x y"), (9, 0, "user", None), (9, 1, "assistant", "z")]
    at = folder(tmp_path, conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    sides = {c: [" ".join(x or "" for d, _, r, x in turns if (d, r) == (c, role)).split() for role in ("user", "assistant")] for c in range(10)}
    errors = sum(distance(*s) for s in sides.values())
    assert tuple(plans.queries()["wer_whole"](spark, at).first()) == (errors, sum(len(s[0]) for s in sides.values()))
    f1 = {c: round(2 * subsequence(*s) / sum(map(len, s)), 6) for c, s in sides.items()}
    assert {r.conv_id: r.rouge_l for r in plans.queries()["rouge_l"](spark, at).collect()} == pytest.approx(f1)


def test_edit_distance_and_subsequence_match_plain_ones(spark):
    rng = random.Random(2)
    rows = [([f"t{rng.randrange(9)}" for _ in range(rng.randrange(12))], [f"t{rng.randrange(9)}" for _ in range(rng.randrange(12))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    got = df.select("r", "h", U.edit_distance("r", "h").alias("n"), U.lcs_length("r", "h").alias("l"))
    assert all(x.n == distance(x.r, x.h) and x.l == subsequence(x.r, x.h) for x in got.collect())


def test_every_document_meets_its_whole_reference(spark, tmp_path):
    items = [(k, f"word passage number {k} of all") for k in range(50)]
    docs = [(k, f"{items[k][1]} and more") for k in range(50)] + [(-1, items[49][1]), (None, "word a b c a b c d"), (100, "word other"), (101, "Wordpassagenumber1ofall!"), (102, f" x {items[2][1].upper()}")]
    at = folder(tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    run = lambda name: {r.doc_id: tuple(r)[1:] for r in plans.queries()[name](spark, at).collect()}
    ids = {d for d, _ in docs}
    f1 = run("token_f1")
    assert f1.keys() == ids and all(f1[k] == (round(12 / 14, 6),) for k in range(50)) and f1[-1] == (1.0,) and f1[None] == (0.0,)
    assert run("repeat_rate").keys() == ids == run("match_evaluators").keys()
    assert run("match_evaluators") == {k: (True, True, False) for k in range(50)} | {-1: (True, True, True), None: (None, None, None), 100: (False, False, False), 101: (False, True, False), 102: (True, False, False)}


def test_all_phrases_patterns_and_predicates(spark):
    texts = ["I can't", "I won't do it", "That is UNETHICAL", "很抱歉", " \u3000\n", None, "Here you go", "No problem"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(I.refused(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [True] * 6 + [False] * 2
    cases = {"答案应该选 B": "B", "A 或 C? 答案选项为： C": "C", "D 是正确的，不是 A": "D", "so the value is \\boxed{B}": "B", "the correct option is: x \\boxed{C}": "C", "答案是 (D)。": "D", "A is wrong, answer: C": "C", "B: yes": "B", "no": "none"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", P.first_option(F.col("t"), default="none").alias("v"))
    assert {r.t: r.v for r in got.collect()} == cases
    lit = F.lit
    checks = [(I.constrained_response(lit(" My answer is no. ")), True), (I.constrained_response(lit("no")), False), (I.number_highlights(lit("*a* **b** ** **"), 2), True), (I.number_highlights(lit("*a* * *"), 2), False), (I.number_sections(lit("Section 1 a\nSection 2 b"), "Section", 2), True), (I.paragraph_first_word(lit("a b\n\n'Dear, c"), 2, 2, "dear"), True), (I.paragraph_first_word(lit("a b\n\nDear"), 1, 1, "a"), False), (I.repeats_prompt(lit(" Say IT now"), "say it"), True)]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(checks)]).first()
    assert list(row) == [v for _, v in checks]
