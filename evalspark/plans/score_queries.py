"""Queries of structured, gated, runtime and judged scores, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions import evaluation as E
from evalspark.functions import structured as S
from evalspark.functions import text as T
from evalspark.operators import diarization as D
from evalspark.operators import joins as J
from evalspark.operators import labelling as L
from evalspark.operators import metrics
from evalspark.plans.catalog import query, r6, r6_all
from evalspark.session import table

_K = "json_extract_string(props, '$.k')::INT"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("m", F.col("event_id") % 4)


@query(rf"""
WITH s AS (SELECT event_id, event_id % 4 AS m, ({_K} = user_id % 100)::INT AS hit, (user_id % 100 = 1)::INT AS one FROM events)
SELECT event_id, (m <> 2)::INT AS json_valid, CASE WHEN m < 2 THEN hit ELSE 0 END AS exact, CASE WHEN m < 2 THEN hit WHEN m = 3 THEN round(one / 3, 6) ELSE 0 END::DOUBLE AS "precision",
  CASE WHEN m < 2 THEN hit WHEN m = 3 THEN one ELSE 0 END::DOUBLE AS recall, CASE WHEN m < 2 THEN hit WHEN m = 3 THEN one / 2 ELSE 0 END::DOUBLE AS f1 FROM s""")
def structured_json(spark, sf_dir):
    e = _events(spark, sf_dir)
    p = F.when(F.col("m") == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("m") == 1, F.concat(F.lit("Sure: "), "props")).when(F.col("m") == 2, "no json").otherwise('{"k": 1, "x": {"y": [1.0, "A"]}}')
    s = S.json_scores(p, F.concat(F.lit('{"k": '), F.col("user_id") % 100, F.lit("}")))
    return r6_all(e.select("event_id", *[c.alias(n) for n, c in s.items()]), "precision")


@query(rf"""
WITH s AS (SELECT event_id, event_id % 4 AS m, ({_K} = user_id % 100)::INT AS hit FROM events)
SELECT event_id, CASE WHEN m = 2 THEN 0 ELSE hit END::DOUBLE AS slot_precision, CASE WHEN m = 2 THEN 0 ELSE hit END::DOUBLE AS slot_recall, CASE WHEN m = 2 THEN 0 ELSE hit END::DOUBLE AS slot_f1 FROM s""")
def slot_f1(spark, sf_dir):
    p = F.when(F.col("m") == 2, "no json").when(F.col("m") == 1, F.concat(F.lit('{"slots": '), "props", F.lit("}"))).otherwise(F.col("props"))
    s = S.item_scores(S.slot_items(p), S.slot_items(F.concat(F.lit('{"k": '), F.col("user_id") % 100, F.lit("}"))))
    return _events(spark, sf_dir).select("event_id", *[s[c].alias(f"slot_{c}") for c in ("precision", "recall", "f1")])


@query(rf"""
WITH s AS (SELECT event_id, event_id % 4 = 3 AS broken, (event_type = 'click')::INT AS tool, ({_K} = user_id % 100)::INT AS arg FROM events)
SELECT event_id, (NOT broken)::INT AS json_valid, CASE WHEN broken THEN 0 ELSE tool END AS tool_acc, CASE WHEN broken THEN 0 ELSE arg END AS parameter_acc, CASE WHEN broken THEN 0 ELSE arg END::DOUBLE AS parameter_f1,
  CASE WHEN broken THEN 0 ELSE tool * arg END AS task_success FROM s""")
def tool_acc(spark, sf_dir):
    call = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}</tool_call>"))
    p = F.when(F.col("m") == 3, "I call nothing").when(F.col("m") == 1, F.concat(F.lit('{"tool_calls": [{"function": {"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}}]}"))).otherwise(call)
    s = S.tool_scores(p, F.concat(F.lit('{"tool": "click", "k": '), F.col("user_id") % 100, F.lit("}")))
    return _events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in s.items()])


@query(r"""
WITH s AS (SELECT event_id, event_id % 2 AS m, (event_type IN ('click', 'view'))::INT AS hit FROM events)
SELECT event_id, round(hit / (2 - m), 6)::DOUBLE AS label_precision, round(hit / 2, 6)::DOUBLE AS label_recall, round(2.0 * hit / (4 - m), 6)::DOUBLE AS f1 FROM s""")
def multilabel_f1(spark, sf_dir):
    p = F.when(F.col("event_id") % 2 == 0, F.concat(F.initcap("event_type"), F.lit(", other"))).otherwise(F.concat(F.lit('{"labels": {"'), "event_type", F.lit('": true, "off": false}}')))
    s = S.item_scores(S.labels_of(p), S.labels_of(F.lit('["Click", "view"]')))
    return _events(spark, sf_dir).select("event_id", r6(s["precision"]).alias("label_precision"), r6(s["recall"]).alias("label_recall"), r6(s["f1"]).alias("f1"))


@query(r"""
WITH s AS (SELECT event_id, event_id % 4 AS m, event_type, user_id FROM events)
SELECT event_id, CASE m WHEN 0 THEN event_type WHEN 1 THEN 'b' WHEN 2 THEN event_type ELSE '' END AS predicted, (CASE m WHEN 1 THEN 'b' WHEN 3 THEN '' ELSE event_type END = CASE m WHEN 1 THEN 'b' ELSE 'view' END)::INT AS accuracy FROM s""")
def classification(spark, sf_dir):
    m = F.col("m")
    p = F.when(m == 0, F.concat(F.lit('{"label": " '), F.upper("event_type"), F.lit(' "}'))).when(m == 1, "It is (B), not A").when(m == 2, F.concat("event_type", F.lit(" "))).otherwise("")
    ref = F.when(m == 1, "B").otherwise("view")
    label = E.class_prediction(p, ref)
    return _events(spark, sf_dir).select("event_id", label.alias("predicted"), (label == E.canonical(ref)).cast("int").alias("accuracy"))


_GATE = r"""
WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 4 THEN true END AS said, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS want FROM events)
SELECT event_id, (said IS NOT NULL AND want IS NOT NULL)::INT AS valid, coalesce(said = want, false)::INT AS acc, CASE WHEN NOT want THEN coalesce(said, true)::INT END AS false_accept, CASE WHEN want THEN coalesce(NOT said, true)::INT END AS false_reject FROM s"""


@query(_GATE)
def response_gate(spark, sf_dir):
    m = F.col("event_id") % 5
    p = F.when(m == 0, '{"should_respond": true}').when(m == 1, "No").when(m == 2, "").when(m == 3, "maybe").otherwise("I think yes, it is")
    want = F.when(F.col("user_id") % 3 == 0, "yes").when(F.col("user_id") % 3 == 1, "否")
    return _events(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in E.gate(p, want, "should_respond", "respond", "answer").items()])


@query(_GATE.replace("acc,", "authorization_acc,").replace("AS acc", "AS authorization_acc").replace("AS false_accept", "AS unauthorized_accept").replace(", CASE WHEN want THEN coalesce(NOT said, true)::INT END AS false_reject", ""))
def authorization(spark, sf_dir):
    m = F.col("event_id") % 5
    p = F.when(m == 0, '{"allow": 1}').when(m == 1, "unauthorized").when(m == 2, "0").when(m == 3, "maybe").otherwise("允许")
    want = F.when(F.col("user_id") % 3 == 0, "true").when(F.col("user_id") % 3 == 1, "false")
    g = E.gate(p, want, "authorized", "allow", "answer")
    return _events(spark, sf_dir).select("event_id", g["valid"].alias("valid"), g["acc"].alias("authorization_acc"), g["false_accept"].alias("unauthorized_accept"))


@query(r"SELECT event_id, (event_id % 10 = user_id % 10)::INT AS target_speaker_acc, (event_id % 10 <> user_id % 10)::INT AS mis_execution FROM events")
def target_speaker(spark, sf_dir):
    said = E.canonical(E.json_field(F.concat(F.lit('{"speaker": " Spk '), F.col("event_id") % 10, F.lit('"}')), "target_speaker", "speaker"))
    want = E.canonical(F.concat(F.lit("SPK  "), F.col("user_id") % 10))
    return _events(spark, sf_dir).select("event_id", (said == want).cast("int").alias("target_speaker_acc"), (said != want).cast("int").alias("mis_execution"))


def _turns(spark, sf_dir):
    """Conversations as segments in time: a turn lasts a second a word, after those before it; its hypothesis begins late
    by up to two seconds and has other speakers (of the next turn, for one in five turns)."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(T.words(F.col("text"))).cast("double"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = c.withColumn("end", F.sum("n").over(w)).withColumn("next", F.lead("role", 1, "other").over(w)).withColumn("place", F.row_number().over(w))
    late = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)).cast("double")
    heard = F.when(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(5)) == 0, F.col("next")).otherwise(F.col("role"))
    seg = lambda start, who: F.struct(start.alias("start"), F.col("end").alias("end"), who.alias("speaker"))
    said = lambda who: F.struct(F.col("place").cast("string").alias("id"), who.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.concat(F.lit("spk-"), F.reverse(F.coalesce(heard, F.lit(""))))
    role = F.coalesce("role", F.lit(""))
    rows = ends.filter("n > 0")
    each = lambda c: F.array_sort(F.collect_list(c))
    return rows.groupBy("conv_id").agg(each(seg(F.col("end") - F.col("n"), role)).alias("r"), each(seg(F.least(F.col("end") - F.col("n") + late, F.col("end") - 0.5), name)).alias("p"), each(said(role)).alias("ru"), each(said(name)).alias("pu"))


@query(None)
def der_pairs(spark, sf_dir):
    """Diarization error of hypotheses that differ from their references: seconds of error and of speech."""
    s = _turns(spark, sf_dir).select("conv_id", D.der_durations("r", "p").alias("d"))
    return s.select("conv_id", r6(F.col("d.error")).alias("error"), r6(F.col("d.reference")).alias("reference"))


@query(None)
def cpwer_pairs(spark, sf_dir):
    """Word error by speaker and attribution of the same hypotheses."""
    s = _turns(spark, sf_dir).select("conv_id", D.attribution_scores("ru", "pu").alias("s"))
    return s.select("conv_id", r6(F.col("s.cpwer")).alias("cpwer"), r6(F.col("s.accuracy")).alias("accuracy"))


@query(r"""
WITH s AS (SELECT event_id, event_id % 3 AS m, value, user_id FROM events)
SELECT event_id, CASE WHEN m = 0 THEN value WHEN m = 1 THEN value / 2 END AS latency_ms, CASE WHEN m = 1 THEN round(value / 100, 6) END AS rtf, NULL::DOUBLE AS memory_peak_mb, (m = 2)::INT AS failure, (m = 0)::INT AS timeout FROM s""")
def runtime_record(spark, sf_dir):
    m, v = F.col("event_id") % 3, F.col("value").cast("string")
    data = F.when(m == 0, F.concat(F.lit('{"runtime": {"latency_ms": '), v, F.lit(', "timeout": "yes"}, "memory_peak_mb": -1}'))).when(m == 1, F.concat(F.lit('{"latency": '), (F.col("value") / 2).cast("string"), F.lit(', "RTF": "'), F.format_string("%.6f", F.round(F.col("value") / 100, 6)), F.lit('"}'))).otherwise('{"failed": true, "latency_ms": "fast"}')
    r = E.runtime_fields(data)
    return _events(spark, sf_dir).select("event_id", *[r[c].alias(c) for c in ("latency_ms", "rtf", "memory_peak_mb", "failure", "timeout")])


@query(r"""
WITH s AS (SELECT event_id, user_id % 8 AS e, event_id % 4 AS st FROM events)
SELECT event_id, CASE WHEN e = 0 THEN 'timeout' WHEN e = 1 THEN 'resource_exhausted' WHEN e = 2 THEN 'input_unavailable' WHEN e = 3 THEN 'infrastructure' WHEN e IN (4, 5) AND st <> 1 THEN 'contract_violation' WHEN st = 1 THEN 'model_runtime' ELSE 'internal' END AS failure_type FROM s""")
def failure_types(spark, sf_dir):
    error = F.element_at(F.array(*map(F.lit, ("TimeoutError", "MemoryError", "FileNotFoundError", "OSError", "ValueError", "KeyError", "RuntimeError", "AssertionError"))), (F.col("user_id") % 8 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, ("prompt", "inference", "post_process", "evaluation"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", E.failure_type(error, stage).alias("failure_type"))


@query(r"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'empty text' WHEN 1 THEN 'no scalar label' WHEN 2 THEN NULL WHEN 3 THEN 'no object or array' WHEN 4 THEN NULL ELSE 'unknown parser' END AS error FROM events""")
def output_shapes(spark, sf_dir):
    m = F.col("event_id") % 6
    p = F.when(m == 0, " ").when(m.isin(1, 2), F.col("props")).when(m == 3, "1").when(m == 4, "out/a.wav").otherwise("x")
    parser = F.when(m == 0, "answer_text@1").when(m == 1, "classification@1").when(m.isin(2, 3), "structured_json@1").when(m == 4, "generated_audio@1").otherwise("other")
    return _events(spark, sf_dir).select("event_id", E.output_error(p, parser).alias("error"))


@query(r"""
WITH s AS (SELECT event_id, event_id % 3 AS m, (event_id % 50)::DOUBLE AS a FROM events)
SELECT event_id, (CASE m WHEN 2 THEN 1 ELSE 2 END)::INT AS n, a AS first_start, CASE m WHEN 0 THEN a + 1.5 ELSE a + 3 END AS last_end FROM s""")
def diarization_segments(spark, sf_dir):
    """Segments of answers: aliased fields, a bare list, and a truncated list of which one object is complete."""
    m, a = F.col("event_id") % 3, (F.col("event_id") % 50).cast("double")
    t = (
        F.when(m == 0, F.format_string('{"segments": [{"begin": %.1f, "duration": 1, "label": "X"}, {"start": %.1f, "end_time": %.1f, "speaker": "y"}]}', a, a + 1, a + 1.5))
        .when(m == 1, F.format_string('```json\n[{"start": %.1f, "end": %.1f, "speaker": "x"}, {"start": %.1f, "end": %.1f, "speaker": "y"}, {"start": 3, "end": 3, "speaker": "z"}]\n```', a, a + 1, a + 2, a + 3))
        .otherwise(F.format_string('[{"start": %.1f, "end": %.1f, "speaker": "x"}, {"start": 9', a, a + 3))
    )
    s = table(spark, sf_dir, "events").select("event_id", D.segments(t).alias("s"))
    return s.select("event_id", F.size("s").alias("n"), F.element_at("s", 1)["start"].alias("first_start"), F.element_at("s", -1)["end"].alias("last_end"))


@query(r"""
WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S') GROUP BY conv_id)
SELECT conv_id, 0.0::DOUBLE AS cpwer, 1.0::DOUBLE AS accuracy FROM c""")
def attribution_of_itself(spark, sf_dir):
    """Attribution of a conversation against itself with the speakers renamed: no error, all utterances right."""
    c = table(spark, sf_dir, "conversations").filter(F.coalesce("text", F.lit("")).rlike("\\S"))
    said = lambda p: F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.concat(F.lit(p), F.coalesce("role", F.lit(""))).alias("speaker"), "text")))
    s = c.groupBy("conv_id").agg(said("r").alias("r"), said("p").alias("p"))
    return s.select("conv_id", D.attribution_scores("r", "p").alias("s")).select("conv_id", "s.cpwer", "s.accuracy")


@query(r"SELECT user_id, round(100.0 * avg((event_type = 'click')::INT), 6) AS acc FROM events GROUP BY user_id")
def original_acc(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r6(100.0 * F.avg(E.exact_match(F.col("event_type"), F.lit("click")))).alias("acc"))
