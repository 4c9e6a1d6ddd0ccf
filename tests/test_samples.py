"""Evaluation samples: missing values, ties, empty tables, broken rules and writers."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import samples as S

SAMPLE = "sample_id string, task string, capability string, scenario string, use_bucket string, metrics array<string>, condition map<string,string>, sources map<string,string>, reviewed boolean, needs_review boolean, extra int"
DECISION = "sample_id string, gate string, patch map<string,string>, condition_patch map<string,string>, metrics_patch array<string>, actions map<string,string>"


def test_patch_applies_compares_with_the_old_values_and_keeps_the_rest(spark):
    s = spark.createDataFrame([("a", "t", "qa", "home", "formal", ["wer"], {"acoustic": "near"}, {"task": "rule"}, True, None, 1), ("b", None, None, None, None, None, None, None, None, None, 2)], SAMPLE)
    d = spark.createDataFrame([("a", None, {"scenario": "car", "task": "t"}, {"acoustic": "far", "device": None}, ["acc"], {"task": "keep", "capability": "flag"})], DECISION)
    a, b = S.patched(s, d, {"qa": ["f1"]}).orderBy("sample_id").collect()
    assert (a.scenario, a.metrics, a.condition, a.gate, a.use_bucket) == ("car", ["acc"], {"acoustic": "far"}, "blocked", "coverage_debt")
    assert sorted(a.changes) == ["condition.acoustic", "metrics", "scenario"] and (a.reviewed, a.needs_review, a.extra) == (False, True, 1)
    assert a.sources == {"task": "knowledge_verified", "scenario": "knowledge_revise", "metrics": "knowledge_revise", "condition.acoustic": "knowledge_revise", "capability": "knowledge_flagged"}
    assert (b.gate, b.changes, b.metrics, b.use_bucket, b.extra) == (None, [], None, None, 2)
    assert S.patched(s.limit(0), d, {}).count() == 0 and S.patched(s, d.limit(0), {}).count() == 2


def test_branches_are_folders_of_a_gate(spark, tmp_path):
    rows = spark.createDataFrame([("a", "pass"), ("b", None), ("c", "blocked")], "sample_id string, gate string")
    S.write_branches(rows, str(tmp_path / "out"))
    read = {g: sorted(json.loads(line)["sample_id"] for f in (tmp_path / "out" / f"gate={g}").glob("*.json") for line in f.read_text().splitlines()) for g in ("pass", "blocked")}
    assert read == {"pass": ["a"], "blocked": ["b", "c"]}


def test_fallback_never_replaces_and_takes_the_least_of_several(spark):
    s = spark.createDataFrame([(1, "own", None), (1, "", []), (2, None, None), (None, None, None)], "k int, task string, metrics array<string>")
    p = spark.createDataFrame([(1, "z", ["m"]), (1, "y", ["l"])], "k int, task string, metrics array<string>")
    got = [(r.k, r.task, r.metrics, [f.field for f in r.filled]) for r in S.with_fallback(s, p, "k", ["task", "metrics"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "own", ["l"], ["metrics"]), (1, "y", ["l"], ["task", "metrics"]), (2, None, None, []), (None, None, None, [])], key=str)


def test_annotations_last_one_counts_and_open_ones_do_not(spark):
    s = spark.createDataFrame([("a", "asr", {"acoustic": "near"}, None, None, None), ("b", "asr", None, None, None, True)], "sample_id string, capability string, condition map<string,string>, reference map<string,string>, sources map<string,string>, reviewed boolean")
    rows = [("a", "capability", "qa", "done", None, "p", 1), ("a", "capability", "tool", "done", None, "", 3), ("a", "capability", "no", "open", "true", "q", 4), ("a", "reference.text", None, "done", None, None, 2), ("b", "label_meta.reviewed", "off", "done", None, None, 1)]
    a = spark.createDataFrame(rows, "sample_id string, label_field string, value string, status string, reviewed string, annotator string, at int")
    x, y = S.with_annotations(s, a, "at").orderBy("sample_id").collect()
    assert (x.capability, x.condition, x.reference, x.reviewed) == ("tool", {"acoustic": "near"}, {"text": ""}, None)
    assert x.sources == {"capability": "human", "reference.text": "human"} and (y.reviewed, y.capability) == (False, "asr")
    assert S.with_annotations(s, a.limit(0), "at").count() == 2


def test_turns_outside_the_view_are_history_and_unknown_names_are_errors(spark):
    t = spark.createDataFrame([("b", "s", n, f"a{n}", None if n == 2 else f"g{n}", "{}" if n == 1 else None, n == 1) for n in range(4)], "benchmark string, speaker string, turn_id int, audio string, answer string, tool_call string, is_clarification boolean")
    got = {r.turn_id: [m.content for m in r.messages] for r in S.dialogue_turns(t, "dialogue", 1).collect()}
    assert got == {0: [], 2: ["a1", "g1"], 3: ["a2", ""]}
    assert [(r.turn_id, r.capability) for r in S.dialogue_turns(t, "clarification").collect()] == [(1, "clarification")]
    assert all(r.messages == [] for r in S.dialogue_turns(t, "all", 0).collect())
    with pytest.raises(ValueError):
        S.dialogue_turns(t, "other")
    with pytest.raises(ValueError):
        S.rendered(t, "{{ absent }}")


def test_majority_and_language(spark):
    v = spark.createDataFrame([(1, ["Yes ", "no", "yes"]), (2, ["a", "b"]), (3, []), (4, None), (5, [None, "x"])], "k int, v array<string>")
    assert {r.k: r.m for r in v.select("k", S.majority(F.col("v")).alias("m")).collect()} == {1: "yes", 2: "no", 3: None, 4: None, 5: "x"}
    names = spark.createDataFrame([(x,) for x in (" ZH_cn", "yue", "Mandarin", "English", "de_AT", "", None)], "l string")
    assert [r[0] for r in names.select(S.language_key(F.col("l"))).collect()] == ["zh", "zh", "zh", "en", "de-at", "", ""]
