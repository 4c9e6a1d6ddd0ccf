"""Queries of evaluation samples: views, protocols, fallbacks, patches, annotations and dialogue turns, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import samples as S
from evalspark.operators.labelling import compact_map
from evalspark.plans.catalog import query
from evalspark.session import table


def _arr(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def _map(**entries):
    """A map of the entries that are not null."""
    whole = F.create_map(*[c for k, v in entries.items() for c in (F.lit(k.replace("__", ".")), v)])
    return F.map_filter(whole, lambda k, v: v.isNotNull()).cast("map<string,string>")


@query(r"""
WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || lang WHEN 1 THEN upper(lang) || '_XX' WHEN 2 THEN 'Cantonese' WHEN 3 THEN 'cmn-Hans' END AS l FROM documents), y AS (SELECT doc_id, replace(lower(trim(coalesce(l, ''))), '_', '-') AS k FROM x)
SELECT doc_id, CASE WHEN k LIKE 'zh%' OR k LIKE 'cmn%' OR k LIKE 'yue%' OR k IN ('chinese', 'mandarin', 'cantonese') THEN 'zh' WHEN k LIKE 'en%' THEN 'en' ELSE k END AS language FROM y""")
def language_keys(spark, sf_dir):
    m = F.col("doc_id") % 5
    name = F.when(m == 0, F.concat(F.lit(" "), "lang")).when(m == 1, F.concat(F.upper("lang"), F.lit("_XX"))).when(m == 2, "Cantonese").when(m == 3, "cmn-Hans")
    return table(spark, sf_dir, "documents").select("doc_id", S.language_key(name).alias("language"))


_PAIRS = r"""
WITH c AS (SELECT event_id, ['asr', 'qa', 'diarization', 'tool_call', 'paralinguistic', 'speech_naturalness', 'emotion_control', 'unheard'][1 + event_id % 8] AS capability,
  ['recognition', 'agent', 'speaker', 'speech_output', 'runtime', 'speech_understanding', 'spoken_agentic_interaction', 'other'][1 + (event_id // 8) % 8] AS task FROM events)"""


def _pairs(spark, sf_dir):
    c = _arr("asr", "qa", "diarization", "tool_call", "paralinguistic", "speech_naturalness", "emotion_control", "unheard")
    k = _arr("recognition", "agent", "speaker", "speech_output", "runtime", "speech_understanding", "spoken_agentic_interaction", "other")
    return table(spark, sf_dir, "events").select("event_id", F.get(c, F.col("event_id") % 8).alias("capability"), F.get(k, F.floor(F.col("event_id") / 8) % 8).alias("task"))


@query(_PAIRS + r""", m AS (SELECT *, task = 'spoken_agentic_interaction' AND capability = 'tool_call' AS known, CASE WHEN capability IN ('asr') THEN 'speech_recognition_transcription' WHEN capability IN ('qa', 'paralinguistic') THEN 'audio_speech_understanding' WHEN capability = 'diarization' THEN 'speaker_attribution' WHEN capability = 'tool_call' THEN 'spoken_agentic_interaction' END AS by_capability FROM c),
n AS (SELECT *, CASE WHEN known THEN task WHEN task = 'runtime' THEN NULL ELSE coalesce(by_capability, CASE task WHEN 'speaker' THEN 'speaker_attribution' WHEN 'agent' THEN 'spoken_agentic_interaction' WHEN 'speech_output' THEN 'speech_generation_delivery' END) END AS new_task FROM m)
SELECT event_id, new_task, CASE WHEN new_task IS NULL THEN NULL WHEN known THEN capability WHEN capability = 'paralinguistic' THEN 'paralinguistic_recognition' WHEN by_capability IS NULL AND task = 'speech_output' THEN 'speech_generation' ELSE capability END AS new_capability FROM n""")
def current_tasks(spark, sf_dir):
    """Old task and capability pairs in today's taxonomy; null where there is no evidence."""
    task, capability = S.current_task(F.col("task"), F.col("capability"), {"spoken_agentic_interaction": ["tool_call"]})
    return _pairs(spark, sf_dir).select("event_id", task.alias("new_task"), capability.alias("new_capability"))


@query(_PAIRS + r""", v AS (SELECT unnest(['native', 'capability_qa', 'task_speaker', 'non_speech', 'speech_understanding', 'agent', 'unnamed']) AS view)
SELECT view, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM c, v WHERE CASE view WHEN 'capability_qa' THEN capability = 'qa' WHEN 'task_speaker' THEN task = 'speaker' WHEN 'non_speech' THEN task <> 'speech_output' AND capability <> 'emotion_control' WHEN 'speech_understanding' THEN task = view WHEN 'agent' THEN task = view ELSE true END GROUP BY view""")
def named_views(spark, sf_dir):
    """Rows and id sums of every kind of view."""
    rows = _pairs(spark, sf_dir)
    parts = [S.view(rows, v).groupBy().agg(F.lit(v).alias("view"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")) for v in ("native", "capability_qa", "task_speaker", "non_speech", "speech_understanding", "agent", "unnamed")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(r"""
WITH s AS (SELECT c_custkey, c_nationkey AS n, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS task, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS scenario FROM customer),
p AS (SELECT s_nationkey AS n, min(s_name) AS task, min('in ' || s_nationkey) AS scenario FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN coalesce(s.task, '') = '' AND p.n IS NOT NULL THEN p.task ELSE s.task END AS task, CASE WHEN s.scenario IS NULL AND p.n IS NOT NULL THEN p.scenario ELSE s.scenario END AS scenario,
  concat_ws('|', CASE WHEN coalesce(s.task, '') = '' AND p.n IS NOT NULL THEN 'task' END, CASE WHEN s.scenario IS NULL AND p.n IS NOT NULL THEN 'scenario' END) AS filled FROM s LEFT JOIN p USING (n)""")
def benchmark_fallback(spark, sf_dir):
    """Missing attributes from the profile of the sample's benchmark, with what was filled."""
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_mktsegment")).alias("task"), F.when(k % 4 > 0, F.col("c_name")).alias("scenario"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_name").alias("task"), F.concat(F.lit("in "), "s_nationkey").alias("scenario"))
    return S.with_fallback(s, p, "n", ["task", "scenario"]).select("c_custkey", "task", "scenario", F.array_join("filled.field", "|").alias("filled"))


_CATALOGUE = {"wer": {"zh": ["cer"], "en": ["wer-en", "length"]}, "acc": ["match"], "f1": ["tokens", "length"]}
_RESOLVED = r"""
WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'asr' WHEN 1 THEN 'qa' ELSE 'x' END AS capability, CASE WHEN doc_id % 7 = 0 THEN 'speech/asr@1' ELSE 'speech/' || CASE doc_id % 3 WHEN 0 THEN 'asr' WHEN 1 THEN 'qa' ELSE 'x' END || '@1' END AS protocol_id, lang,
  CASE WHEN doc_id % 11 = 0 THEN ['f1', 'new'] END AS hint_metrics, CASE WHEN doc_id % 13 = 0 THEN ['own'] END AS hint_evaluators, doc_id % 5 = 0 AS lacks FROM documents),
r AS (SELECT *, protocol_id <> 'speech/x@1' AS found, coalesce(hint_metrics, CASE protocol_id WHEN 'speech/asr@1' THEN ['wer', 'f1'] WHEN 'speech/qa@1' THEN ['acc'] ELSE [] END) AS metrics FROM s),
e AS (SELECT *, list_contains(metrics, 'wer') AND coalesce(lang, '') <> 'en' AS unrouted, list_contains(metrics, 'new') AS unknown,
  CASE WHEN hint_evaluators IS NOT NULL THEN 'own' WHEN NOT found THEN '' WHEN list_contains(metrics, 'wer') AND lang = 'en' THEN 'wer-en|length|tokens' WHEN list_contains(metrics, 'f1') THEN 'tokens|length' ELSE 'match' END AS evaluators FROM r)"""


def _resolved(spark, sf_dir, formal):
    k = F.col("doc_id")
    capability = F.when(k % 3 == 0, "asr").when(k % 3 == 1, "qa").otherwise("x")
    s = table(spark, sf_dir, "documents").select("doc_id", F.lit("speech").alias("task"), capability.alias("capability"), F.when(k % 7 == 0, "speech/asr@1").alias("capability_protocol"), F.col("lang").alias("language"), F.when(k % 11 == 0, _arr("f1", "new")).alias("hint_metrics"), F.when(k % 13 == 0, _arr("own")).alias("hint_evaluators"), F.lit("").alias("hint_prompt"), F.create_map(F.lit("text"), F.when(k % 5 > 0, "x")).alias("reference"))
    p = spark.createDataFrame([("speech/asr@1", "speech", "asr", ["text"], ["wer", "f1"], [], "write"), ("speech/qa@1", "speech", "qa", ["text"], ["acc"], [], "answer")], "id string, task string, capability string, required_reference array<string>, metrics array<string>, evaluators array<string>, prompt string")
    return S.resolved(s, p, _CATALOGUE, formal)


@query(_RESOLVED + r""" SELECT doc_id, protocol_id, array_to_string(metrics, '|') AS metrics, evaluators, CASE WHEN NOT found THEN 'no mapped protocol: ' || protocol_id WHEN protocol_id <> 'speech/' || capability || '@1' THEN 'task or capability does not match' WHEN lacks THEN 'missing reference: text'
  WHEN unrouted AND hint_evaluators IS NULL THEN 'no evaluator of the language: wer' WHEN unknown THEN 'unmapped metrics: new' END AS error FROM e""")
def protocol_formal(spark, sf_dir):
    """Protocols, metrics and evaluators of a formal run, and what would stop it."""
    return _resolved(spark, sf_dir, True).select("doc_id", "protocol_id", F.array_join("metrics", "|").alias("metrics"), F.array_join("evaluators", "|").alias("evaluators"), "error")


@query(_RESOLVED + r""" SELECT doc_id, evaluators, CASE WHEN found THEN 'protocol_registry' ELSE 'diagnostic_fallback' END AS resolution, CASE WHEN found AND protocol_id <> 'speech/' || capability || '@1' THEN 'task or capability does not match' END AS error,
  concat_ws('|', CASE WHEN NOT found THEN 'unmapped protocol: ' || protocol_id END, CASE WHEN found AND unrouted THEN 'no evaluator of the language: wer' END, CASE WHEN found AND lacks THEN 'missing reference: text' END) AS warnings FROM e""")
def protocol_diagnostic(spark, sf_dir):
    """The same of a diagnostic run, which warns."""
    return _resolved(spark, sf_dir, False).select("doc_id", F.array_join("evaluators", "|").alias("evaluators"), "resolution", "error", F.array_join("warnings", "|").alias("warnings"))


@query(r"""SELECT doc_id, source AS scenario__primary, CASE WHEN doc_id % 2 = 0 THEN lang END AS scenario__secondary, CASE WHEN doc_id % 3 > 0 THEN lang || '|' || source END AS metadata__language, CASE WHEN doc_id % 3 <> 1 THEN NULL ELSE 'far' END AS metadata__distance,
  'a' || doc_id AS WavPath, NULL::VARCHAR AS WavPath2, CASE WHEN doc_id % 4 = 0 THEN 'c' END AS WavPath3 FROM documents""")
def runtime_projection(spark, sf_dir):
    """Scenario, listed metadata and audio paths as flat columns."""
    k = F.col("doc_id")
    lists = F.when(k % 3 == 0, F.create_map(F.lit("distance"), _arr())).when(k % 3 == 1, F.create_map(F.lit("language"), F.array("lang", "source"), F.lit("distance"), _arr("far"))).otherwise(F.create_map(F.lit("language"), F.array("lang", "source")))
    audio = F.when(k % 4 == 0, F.array(F.concat(F.lit("a"), k), F.lit(""), F.lit("c"))).otherwise(F.array(F.concat(F.lit("a"), k)))
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("source").alias("primary"), F.when(k % 2 == 0, F.col("lang")).alias("secondary")).alias("scenario"), lists.alias("metadata"), audio.alias("audio"))
    return S.runtime_columns(d, ["language", "distance"], 3).drop("scenario", "metadata", "audio")


@query(r"""
WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'asr' ELSE 'qa' END AS capability, CASE WHEN c_custkey % 5 > 0 THEN 'wer' END AS metrics, CASE c_custkey % 4 WHEN 0 THEN 'far' ELSE 'near' END AS acoustic, c_custkey % 6 > 0 AS decided,
  CASE c_custkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass_with_revise' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'blocked' END AS gate, CASE WHEN c_custkey % 7 = 0 THEN 'qa' END AS to_capability, CASE WHEN c_custkey % 3 = 0 THEN 'far' END AS to_acoustic FROM customer),
d AS (SELECT *, CASE WHEN decided THEN coalesce(gate, 'blocked') END AS g, decided AND coalesce(to_capability <> capability, false) AS cc, decided AND coalesce(to_acoustic <> acoustic, false) AS ca, CASE WHEN decided THEN coalesce(to_capability, capability) ELSE capability END AS now FROM s)
SELECT id AS sample_id, now AS capability, CASE WHEN decided AND (cc OR metrics IS NULL) AND now = 'qa' THEN 'acc' ELSE coalesce(metrics, '') END AS metrics, CASE WHEN decided THEN coalesce(to_acoustic, acoustic) ELSE acoustic END AS acoustic, g AS gate, concat_ws('|', CASE WHEN cc THEN 'capability' END, CASE WHEN ca THEN 'condition.acoustic' END) AS changes,
  CASE g WHEN 'blocked' THEN 'coverage_debt' WHEN 'needs_review' THEN 'diagnostic_evidence' ELSE 'formal' END AS use_bucket, CASE WHEN g IN ('blocked', 'needs_review') THEN false END AS reviewed, CASE WHEN g IN ('blocked', 'needs_review') THEN true WHEN g IS NOT NULL THEN false END AS needs_review,
  concat_ws('|', CASE WHEN decided AND to_capability IS NOT NULL THEN 'capability=knowledge_revise' END, CASE WHEN decided AND to_acoustic IS NOT NULL THEN 'condition.acoustic=knowledge_revise' END, CASE WHEN decided THEN 'scenario=knowledge_flagged' END, 'task=' || CASE WHEN decided THEN 'knowledge_verified' ELSE 'rule' END) AS sources FROM d""")
def patched_samples(spark, sf_dir):
    """Decisions of a knowledge check applied to samples, with their gate, sources and changes."""
    k, null = F.col("c_custkey"), F.lit(None)
    c = table(spark, sf_dir, "customer")
    s = c.select(k.alias("sample_id"), F.lit("t").alias("task"), F.when(k % 2 == 0, "asr").otherwise("qa").alias("capability"), F.lit("home").alias("scenario"), F.lit("formal").alias("use_bucket"), F.when(k % 5 > 0, _arr("wer")).alias("metrics"), F.create_map(F.lit("acoustic"), F.when(k % 4 == 0, "far").otherwise("near")).alias("condition"), F.create_map(F.lit("task"), F.lit("rule")).alias("sources"), null.cast("boolean").alias("reviewed"), null.cast("boolean").alias("needs_review"))
    gate = F.when(k % 5 == 0, "pass").when(k % 5 == 1, "pass_with_revise").when(k % 5 == 2, "needs_review").when(k % 5 == 3, "blocked")
    d = c.filter(k % 6 > 0).select(k.alias("sample_id"), gate.alias("gate"), _map(capability=F.when(k % 7 == 0, "qa")).alias("patch"), _map(acoustic=F.when(k % 3 == 0, "far")).alias("condition_patch"), null.cast("array<string>").alias("metrics_patch"), F.create_map(F.lit("task"), F.lit("keep"), F.lit("scenario"), F.lit("flag"), F.lit("other"), F.lit("revise")).alias("actions"))
    out = S.patched(s, d, {"qa": ["acc"]})
    return out.select("sample_id", "capability", F.coalesce(F.array_join("metrics", "|"), F.lit("")).alias("metrics"), F.col("condition")["acoustic"].alias("acoustic"), "gate", F.array_join("changes", "|").alias("changes"), "use_bucket", "reviewed", "needs_review", compact_map(F.col("sources")).alias("sources"))


@query(r"""
WITH a AS (SELECT o_custkey AS id, o_orderkey AS pos, ['capability', 'condition.acoustic', 'reference.text', 'label_meta.reviewed'][1 + o_orderkey % 4] AS f, CASE o_orderkey % 4 WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'Yes' ELSE 'off' END ELSE 'v' || o_orderkey END AS v, o_orderpriority LIKE '1%' AS r, CASE WHEN o_orderkey % 3 > 0 THEN 'p' || o_orderkey % 9 END AS who FROM orders WHERE o_orderstatus <> 'O'),
l AS (SELECT id, f, max_by(v, pos) AS v, bool_or(r) AS r, max(pos) FILTER (who IS NOT NULL) AS last_pos FROM a GROUP BY ALL),
o AS (SELECT id, max(v) FILTER (f = 'capability') AS c, max(v) FILTER (f = 'condition.acoustic') AS ac, max(v) FILTER (f = 'reference.text') AS tx, max(v) FILTER (f = 'label_meta.reviewed') AS rv, bool_or(r) AS r, max(last_pos) AS pos, string_agg(f || '=human', '|' ORDER BY f) AS src FROM l GROUP BY id)
SELECT c_custkey AS sample_id, coalesce(c, 'asr') AS capability, coalesce(ac, 'near') AS acoustic, tx AS text, CASE WHEN r THEN true WHEN rv IS NOT NULL THEN rv = 'Yes' ELSE false END AS reviewed, who AS annotator, coalesce(src, '') AS sources FROM customer LEFT JOIN o ON id = c_custkey LEFT JOIN (SELECT pos, who FROM a) w USING (pos)""")
def human_annotations(spark, sf_dir):
    """Annotations that are done written into their samples; the last of a field counts."""
    k = F.col("o_orderkey")
    field = F.get(_arr("capability", "condition.acoustic", "reference.text", "label_meta.reviewed"), k % 4)
    value = F.when(k % 8 == 3, "Yes").when(k % 4 == 3, "off").otherwise(F.concat(F.lit("v"), k))
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), field.alias("label_field"), value.alias("value"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.when(F.col("o_orderpriority").startswith("1"), "True").alias("reviewed"), F.when(k % 3 > 0, F.concat(F.lit("p"), k % 9)).alias("annotator"), k.alias("at"))
    empty = F.create_map().cast("map<string,string>")
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit("asr").alias("capability"), F.create_map(F.lit("acoustic"), F.lit("near")).alias("condition"), empty.alias("reference"), empty.alias("sources"), F.lit(False).alias("reviewed"))
    out = S.with_annotations(s, a, "at")
    return out.select("sample_id", "capability", F.col("condition")["acoustic"].alias("acoustic"), F.try_element_at("reference", F.lit("text")).alias("text"), "reviewed", "annotator", compact_map(F.col("sources")).alias("sources"))


@query(r"""
WITH x AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS u, CASE WHEN turn % 3 = 1 THEN '{}' END AS tool, turn % 4 = 1 AS clar FROM conversations),
h AS (SELECT *, list('user:' || u || '|assistant:' || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l FROM x)
SELECT 'dialogue' AS view, conv_id, turn, CASE WHEN clar THEN 'clarification' ELSE 'multi_turn_dialogue' END AS capability, coalesce(array_to_string(l, '|'), '') AS messages FROM h WHERE tool IS NULL
UNION ALL SELECT 'tool_call', conv_id, turn, 'tool_call', coalesce(array_to_string(l, '|'), '') FROM h WHERE tool IS NOT NULL UNION ALL SELECT 'clarification', conv_id, turn, 'clarification', coalesce(array_to_string(l, '|'), '') FROM h WHERE clar
UNION ALL SELECT 'all', conv_id, turn, CASE WHEN tool IS NOT NULL THEN 'tool_call' WHEN clar THEN 'clarification' ELSE 'multi_turn_dialogue' END, coalesce(array_to_string(l, '|'), '') FROM h""")
def dialogue_views(spark, sf_dir):
    """Turns of every view with the messages of the two turns before."""
    n = F.col("turn")
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("audio"), n.cast("string").alias("answer"), F.when(n % 3 == 1, "{}").alias("tool_call"), (n % 4 == 1).alias("is_clarification"))
    out = None
    for v in ("dialogue", "tool_call", "clarification", "all"):
        said = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
        part = S.dialogue_turns(x, v, 2, ("conv_id",), "turn").select(F.lit(v).alias("view"), "conv_id", "turn", "capability", said.alias("messages"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey, 'Say ' || n_name || ' (' || n_regionkey || ') {in} ' || n_name || '.' AS prompt FROM nation")
def prompt_render(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", S.rendered(n, "Say {{ n_name }} ({{n_regionkey}}) {in} {{n_name}}.").alias("prompt"))


@query(r"""SELECT user_id, CASE WHEN count(*) FILTER (value > 50) > count(*) FILTER (value <= 50) THEN 'yes' ELSE 'no' END AS vote FROM events GROUP BY user_id""")
def majority_vote(spark, sf_dir):
    """The judges' majority; a draw is no."""
    votes = F.collect_list(F.when(F.col("value") > 50, " Yes").otherwise("NO"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(votes.alias("v")).select("user_id", S.majority(F.col("v")).alias("vote"))
