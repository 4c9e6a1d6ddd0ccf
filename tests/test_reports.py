"""Answer ladders, tracks, ensembles, reports."""

from pyspark.sql import functions as F

from evalspark.functions import ladders
from evalspark.operators import joins
from evalspark.session import scratch
from evalspark.sources import manifests, reports


def test_ladders_follow_their_order(spark):
    said = {
        "The answer is: **No**": 0, "final answer yes": 1, "<1>No, she lies": 0, "The answer is Bob; he tells the truth": 1, "the answer is $\\boxed{\\text{false}}$": 0, "the answer is \\boxed{yes}": 1,
        "Ann must be lying.": 1, "she lies": 0, "yes<|turn_end|>": 1, "maybe<|user|>": None, "": None, None: None, "I do not know": None, "the answer is no. yes": 0,
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.a for r in rows.select("t", ladders.answered(F.col("t"), ladders.LIES).alias("a")).collect()} == said
    assert len(ladders.YES_NO) == 30 and ladders.YES_NO[:2] == (("answer is no", 0), ("answer is yes", 1))
    own = {"sports": (("plausible", 1),), "navigate": ladders.NAVIGATE}
    df = spark.createDataFrame([("it is plausible", "yes", "sports_1"), ("you end up back at the starting point", "No", "x_navigate"), ("hm", "(B)", "navigate"), ("yes", "yes", "other")], "t string, l string, k string")
    got = df.select(*[c.alias(n) for n, c in ladders.puzzle_scores(F.col("t"), F.col("l"), F.col("k"), own).items()]).collect()
    assert list(map(tuple, got)) == [(1, 1, 0), (0, 1, 0), (0, None, 1), (None, None, None)]


def test_tracks_of_short_and_open_answers(spark):
    df = spark.createDataFrame([("knowledge", 1, None, None), ("single_round_a", 1, 2.0, None), ("open", 0, 3.0, None), ("open_ended", 1, None, None), (None, 1, 5.0, "open"), ("open", 1, None, "short"), (None, 0, None, "")], "s string, m int, j double, t string")
    parts = ladders.split_track(F.col("m"), F.col("j"), F.col("s"), F.col("t"))
    got = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert list(map(tuple, got)) == [("short", 1, None), ("open", 0, 0), ("open", 1, 0), ("open", 0, 1), ("open", 1, 0), ("short", 1, None), ("short", 0, None)]


def test_reports_escape_what_parts_cells(spark):
    df = spark.createDataFrame([(2, "a|b", ["x", "y"], {"q": 1, "p": 2}), (1, None, [], {}), (3, 'say "hi"\nthere, now', None, None)], "k int, t string, l array<string>, m map<string,int>")
    assert [r.line for r in reports.markdown(df, ["k", "t"], ["k"]).collect()] == ["| k | t |", "| --- | --- |", "| 1 |  |", "| 2 | a\\|b |", '| 3 | say "hi"<br>there, now |']
    path = scratch(spark, "csv")
    reports.write_csv(df, path)
    back = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema("k int, t string, l string, m string").csv(path).orderBy("k").collect()
    assert [(r.k, r.t, r.l or "", r.m or "") for r in back] == [(1, None, "", ""), (2, "a|b", "x|y", "p=2|q=1"), (3, 'say "hi"\nthere, now', "", "")]


def test_captions_and_prompts_of_repeated_keys(spark):
    index = spark.createDataFrame([("a", "b", ["x", None, ""], 1), ("b", None, ["y"], 2), ("c", "", [], 3)], "audio_path string, audio_filepath string, captions array<string>, line int")
    samples = spark.createDataFrame([(k,) for k in ("a", "b", "c", "", None)], "p string")
    assert {r.p: r.captions for r in joins.caption_references(samples, index, "p").collect()} == {"a": ["x"], "b": ["y"], "c": None, "": None, None: None}
    at = scratch(spark, "prompts")
    spark.createDataFrame([("s|hello|there",), ("t|x",), ("",)], "value string").write.text(f"{at}/a")
    spark.createDataFrame([("s|second",), ("s|first",)], "value string").write.text(f"{at}/b")
    assert sorted(map(tuple, manifests.prompted(spark, f"{at}/a", f"{at}/b").collect())) == [("s", "hello|there", "first"), ("t", "x", None)]
