"""Evaluation samples: views, protocols, fallbacks, patches and annotations applied, flat projections, dialogue turns.

Rules that a team keeps as files (taxonomies, metric catalogues) are given as plain dictionaries and become literals of
one projection; what grows with the data (profiles, decisions, annotations) is a DataFrame and is joined by its key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evalspark.functions import text as T

_STRINGS = "array<string>"

# fixed values: old capabilities by the task that they belong to now
TASK_OF_CAPABILITY = {
    "speech_recognition_transcription": ("asr", "long_form_asr", "speech_translation", "code_switch"),
    "audio_speech_understanding": ("audio_reasoning", "audio_caption", "sound_event", "acoustic_scene", "paralinguistic", "paralinguistic_recognition", "qa", "meeting_summary", "meeting_qa", "timeline_query", "todo_extraction"),
    "speaker_attribution": ("speaker_count", "speaker_verification", "diarization", "speaker_attribution", "target_speaker", "spoof_detection"),
    "spoken_agentic_interaction": ("instruction_following", "tool_call", "navigation", "calendar", "reminder", "phone_message", "music_control", "vehicle_control", "translation_instruction", "multi_turn_dialogue", "clarification", "interruption"),
}
# fixed values: tasks that decide where no capability does
TASK_OF_TASK = {"speaker": "speaker_attribution", "agent": "spoken_agentic_interaction", "speech_output": "speech_generation_delivery"}


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast(_STRINGS)


def _present(df: DataFrame, name: str) -> Column:
    """Whether a column holds a value: not null, and no empty text or list."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    empty = F.size(c) == 0 if isinstance(kind, (t.ArrayType, t.MapType)) else (c == "" if isinstance(kind, t.StringType) else F.lit(False))
    return c.isNotNull() & ~F.coalesce(empty, F.lit(False))


def _over(base: Column, new: Column) -> Column:
    """A map with the entries of another over its own."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(base, empty), F.coalesce(new, empty), lambda _, old, over: F.coalesce(over, old))


def language_key(language: Column) -> Column:
    """zh for all names of Chinese, en for all of English, else the name in lower case with hyphens."""
    key = F.replace(F.lower(T.strip(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-"))
    chinese = key.rlike("^(zh|cmn|yue)") | key.isin("chinese", "mandarin", "cantonese")
    return F.when(chinese, "zh").when(key.startswith("en"), "en").otherwise(key)


def current_task(task: Column, capability: Column, taxonomy: dict[str, list[str]]) -> tuple[Column, Column]:
    """(task, capability) of an old pair. A pair of the taxonomy stays; runtime, and pairs without evidence, are null."""
    known = F.lit(False)
    for name, capabilities in taxonomy.items():
        known = known | ((task == name) & capability.isin(*capabilities))
    by_capability = F.lit(None).cast("string")
    for name, capabilities in TASK_OF_CAPABILITY.items():
        by_capability = F.when(capability.isin(*capabilities), name).otherwise(by_capability)
    by_task = F.lit(None).cast("string")
    for old, name in TASK_OF_TASK.items():
        by_task = F.when(task == old, name).otherwise(by_task)
    new = F.when(F.coalesce(known, F.lit(False)), task).when(task == "runtime", None).otherwise(F.coalesce(by_capability, by_task))
    renamed = F.when(capability == "paralinguistic", "paralinguistic_recognition").when(by_capability.isNull() & (task == "speech_output"), "speech_generation").otherwise(capability)
    return new, F.when(new.isNull(), None).when(F.coalesce(known, F.lit(False)), capability).otherwise(renamed)


def view(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a named view of (task, capability): native, all, capability_<c>, task_<t>, non_speech,
    speech_understanding or agent; other names leave all rows in. Missing values count as empty."""
    task, capability = (F.lower(T.strip(F.coalesce(c, F.lit("")))) for c in ("task", "capability"))
    if name.startswith("capability_"):
        return rows.filter(capability == name.removeprefix("capability_"))
    if name.startswith("task_"):
        return rows.filter(task == name.removeprefix("task_"))
    if name == "non_speech":
        return rows.filter((task != "speech_output") & ~capability.isin("emotion_control", "style_following"))
    return rows.filter(task == name) if name in ("speech_understanding", "agent") else rows


def with_fallback(samples: DataFrame, profiles: DataFrame, key: str, fields: list[str], confidence: float = 0.25) -> DataFrame:
    """samples with missing fields filled from the profile of their key, and `filled`: what was, with its source.

    Values of the sample are never replaced. Several profiles of one key: the least one, field by field; none: nothing
    is filled.
    """
    one = profiles.groupBy(F.col(key).alias("_k")).agg(*[F.min(f).alias(f"_p_{f}") for f in fields], F.lit(True).alias("_found"))
    joined = samples.join(one, samples[key] == one["_k"], "left")
    takes = {f: ~_present(samples, f) & F.col("_found").isNotNull() for f in fields}
    note = lambda f: F.struct(F.lit(f).alias("field"), F.lit("benchmark_fallback").alias("source"), F.col(key).cast("string").alias("benchmark"), F.lit(confidence).alias("confidence"))
    filled = F.array_compact(F.array(*[F.when(takes[f], note(f)) for f in fields]))
    own = [F.when(takes[c], F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in takes else F.col(c) for c in samples.columns]
    return joined.select(*own, filled.alias("filled"))


def resolved(samples: DataFrame, protocols: DataFrame, catalogue: dict[str, list[str] | dict[str, list[str]]], formal: bool = True) -> DataFrame:
    """samples with the protocol under which they are scored.

    samples hold task, capability, capability_protocol, language, reference (map) and hint_metrics, hint_evaluators
    (arrays), hint_prompt; protocols hold id, task, capability, required_reference, metrics, evaluators, prompt. The
    catalogue names a metric's evaluators, by language where they depend on it. Hints of a sample go before its
    protocol. What would stop a formal run is told in `error`, by the first rule broken (the row is kept); in a
    diagnostic run it is a warning, and a sample without protocol is scored by its hints.
    """
    named = F.coalesce(T.nz(F.col("capability_protocol")), F.concat("task", F.lit("/"), "capability", F.lit("@1")))
    body = ("task", "capability", "required_reference", "metrics", "evaluators", "prompt")
    one = protocols.groupBy(F.col("id").alias("protocol_id")).agg(F.min(F.struct(*body)).alias("_p"))
    rows = samples.withColumn("protocol_id", named).join(one, "protocol_id", "left")
    given = lambda hint, own: F.coalesce(F.when(F.size(F.col(hint)) > 0, F.col(hint)), own, _strings([]))
    metrics, declared = given("hint_metrics", F.col("_p.metrics")), given("hint_evaluators", F.col("_p.evaluators"))
    routes = {}
    for metric, found in catalogue.items():
        routes |= {f"{metric}\n{lang}": e for lang, e in found.items()} if isinstance(found, dict) else {f"{metric}\n": found}
    table = F.create_map(*[c for k, e in routes.items() for c in (F.lit(k), _strings(e))])
    by_language = _strings([m for m, found in catalogue.items() if isinstance(found, dict)])
    lang = language_key(F.col("language"))
    route = lambda m: F.try_element_at(table, F.concat(m, F.lit("\n"), F.when(F.array_contains(by_language, m), lang).otherwise("")))
    listed = F.array_distinct(F.flatten(F.transform(metrics, lambda m: F.coalesce(route(m), _strings([])))))
    unknown = F.array_sort(F.filter(metrics, lambda m: ~F.array_contains(_strings(catalogue), m)))
    unrouted = F.filter(metrics, lambda m: F.array_contains(by_language, m) & route(m).isNull())
    lacking = F.filter(F.coalesce(F.col("_p.required_reference"), _strings([])), lambda f: F.coalesce(F.try_element_at("reference", f), F.lit("")) == "")
    found, said = F.col("_p").isNotNull(), lambda text, names: F.concat(F.lit(text), F.array_join(names, ", "))
    mismatch = found & ~(F.col("_p.task").eqNullSafe(F.col("task")) & F.col("_p.capability").eqNullSafe(F.col("capability")))
    no_route = (F.size(unrouted) > 0) & (F.size(declared) == 0)
    strict = F.lit(formal)
    error = (
        F.when(~found & strict, F.concat(F.lit("no mapped protocol: "), F.col("protocol_id")))
        .when(mismatch, F.lit("task or capability does not match"))
        .when(found & strict & (F.size(lacking) > 0), said("missing reference: ", lacking))
        .when(found & strict & no_route, said("no evaluator of the language: ", unrouted))
        .when(found & strict & (F.size(unknown) > 0), said("unmapped metrics: ", unknown))
    )
    warnings = F.array_compact(F.array(
        F.when(~found, F.concat(F.lit("unmapped protocol: "), F.col("protocol_id"))),
        F.when(found & (F.size(unrouted) > 0), said("no evaluator of the language: ", unrouted)),
        F.when(found & (F.size(lacking) > 0), said("missing reference: ", lacking)),
    ))
    out = rows.withColumns({
        "metrics": metrics, "evaluators": F.when((F.size(declared) > 0) | ~found, declared).otherwise(listed),
        "prompt": F.coalesce(T.nz(F.col("hint_prompt")), F.col("_p.prompt"), F.lit("")), "resolution": F.when(found, "protocol_registry").otherwise("diagnostic_fallback"), "warnings": warnings, "error": error,
    })
    stable = F.struct("protocol_id", "metrics", "evaluators", "prompt", "resolution", "warnings")
    added = ("protocol_id", "resolution", "metrics", "evaluators", "prompt", "warnings", "error")
    return out.withColumn("protocol_hash", F.sha2(F.to_json(stable), 256)).select(*samples.columns, *added, "protocol_hash")


def runtime_columns(samples: DataFrame, slice_fields: list[str], audios: int = 2) -> DataFrame:
    """samples (scenario struct, metadata map of lists, audio array of uris) with their flat columns: scenario__primary
    and scenario__secondary, metadata__<field> with lists joined by |, WavPath, WavPath2 and so on up to `audios`.

    Audio beyond that stays in its array. Empty values are null; an empty uri keeps its place in the numbering.
    """
    text = lambda f: T.nz(F.array_join(F.try_element_at("metadata", F.lit(f)), "|"))
    paths = {"WavPath" if k == 0 else f"WavPath{k + 1}": T.nz(F.get("audio", F.lit(k))) for k in range(audios)}
    scenario = {f"scenario__{p}": T.nz(F.col(f"scenario.{p}")) for p in ("primary", "secondary")}
    return samples.withColumns(scenario | {f"metadata__{f}": text(f) for f in slice_fields} | paths)


def patched(samples: DataFrame, decisions: DataFrame, default_metrics: dict[str, list[str]]) -> DataFrame:
    """samples with the decision of their sample_id applied, `changes` listing the fields that got another value.

    samples hold task, capability, scenario, use_bucket, metrics (array), condition and sources (maps), reviewed and
    needs_review; decisions hold gate, patch and condition_patch (maps), metrics_patch (array) and actions (field to
    keep, revise or flag). Samples without a decision stay as they are, with a null gate and no changes; of several
    decisions of one sample the one with the least gate, then patch as JSON, counts.
    """
    value = F.struct("gate", "patch", "condition_patch", "metrics_patch", "actions")
    one = decisions.groupBy("sample_id").agg(F.min_by(value, F.struct("gate", F.to_json("patch"), F.to_json("condition_patch"))).alias("_d"))
    rows = samples.join(one, "sample_id", "left")
    plain = ("task", "capability", "scenario", "use_bucket")
    new = {f: F.try_element_at("_d.patch", F.lit(f)) for f in plain}
    differs = lambda a, b: b.isNotNull() & ~a.eqNullSafe(b)
    empty = F.create_map().cast("map<string,string>")
    conditions = F.map_filter(F.coalesce("_d.condition_patch", empty), lambda k, v: v.isNotNull())
    # (both maps as arguments: a lambda that names `condition` would see the column of that name in the new rows)
    unequal = F.map_zip_with(conditions, F.coalesce("condition", empty), lambda k, new, was: new.isNotNull() & ~new.eqNullSafe(was))
    changed = F.map_keys(F.map_filter(unequal, lambda k, v: v))
    changes = F.concat(
        F.array_compact(F.array(*[F.when(differs(F.col(f), new[f]), f) for f in plain], F.when(differs(F.col("metrics"), F.col("_d.metrics_patch")), "metrics"))),
        F.transform(F.array_sort(changed), lambda k: F.concat(F.lit("condition."), k)),
    )
    names = F.array_compact(F.array(*[F.when(new[f].isNotNull(), f) for f in plain], F.when(F.col("_d.metrics_patch").isNotNull(), "metrics")))
    revised = F.concat(names, F.transform(F.map_keys(conditions), lambda k: F.concat(F.lit("condition."), k)))
    by_patch = F.map_from_arrays(revised, F.transform(revised, lambda _: F.lit("knowledge_revise")))
    acted = F.map_filter(F.coalesce("_d.actions", empty), lambda k, v: v.isin("keep", "flag"))
    by_action = F.transform_values(acted, lambda k, v: F.when(v == "keep", "knowledge_verified").otherwise("knowledge_flagged"))
    capability = F.coalesce(new["capability"], F.col("capability"))
    defaults = F.lit(None).cast(_STRINGS)
    for c, m in default_metrics.items():
        defaults = F.when(capability == c, _strings(m)).otherwise(defaults)
    metrics = F.coalesce(F.col("_d.metrics_patch"), F.col("metrics"))
    by_default = differs(F.col("capability"), new["capability"]) | (F.coalesce(F.size(metrics), F.lit(0)) <= 0)
    gate = F.when(F.col("_d").isNotNull(), F.coalesce("_d.gate", F.lit("blocked")))
    held, decided = gate.isin("needs_review", "blocked"), F.col("_d").isNotNull()
    out = {f: F.coalesce(new[f], F.col(f)) for f in plain} | {
        "use_bucket": F.when(gate == "blocked", "coverage_debt").when(gate == "needs_review", "diagnostic_evidence").otherwise(F.coalesce(new["use_bucket"], F.col("use_bucket"))),
        "metrics": F.when(decided & by_default, F.coalesce(defaults, metrics)).otherwise(metrics),
        "condition": _over(F.col("condition"), conditions), "sources": _over(F.col("sources"), _over(by_patch, by_action)),
        "reviewed": F.when(held, False).otherwise(F.col("reviewed")),
        "needs_review": F.when(held, True).when(gate.isin("pass", "pass_with_revise"), False).otherwise(F.col("needs_review")),
        "gate": gate, "changes": changes,
    }
    kept = [c for c in samples.columns if c not in out]
    return rows.select(*kept, *[c.alias(n) for n, c in out.items()])


def write_branches(samples: DataFrame, path: str) -> None:
    """JSON lines in one folder per gate; samples without a gate go with the blocked ones."""
    samples.withColumn("gate", F.coalesce("gate", F.lit("blocked"))).write.mode("errorifexists").partitionBy("gate").json(path)


def with_annotations(samples: DataFrame, annotations: DataFrame, order: str) -> DataFrame:
    """samples (capability, condition, reference and sources maps, reviewed) with people's annotations (sample_id,
    label_field, value, status, reviewed, annotator) that are done; of one field the last by `order` counts.

    condition.<x> and reference.<x> go into their maps, label_meta.reviewed and other names into their columns; every
    annotated field has source human, and one reviewed annotation makes the sample reviewed.
    """
    value = F.coalesce("value", F.lit(""))
    done = annotations.filter(F.col("status") == "done")
    last = done.groupBy("sample_id", "label_field").agg(
        F.max_by(value, order).alias("value"), F.max(F.lower("reviewed") == "true").alias("reviewed"), F.max(F.when(F.coalesce("annotator", F.lit("")) != "", F.struct(order, "annotator"))).alias("by"),
    )
    one = last.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("label_field", "value"))).alias("_f"), F.coalesce(F.max("reviewed"), F.lit(False)).alias("_r"), F.max("by").alias("_by"))
    rows = samples.join(one, "sample_id", "left")
    part = lambda p: F.transform_keys(F.map_filter("_f", lambda k, v: k.startswith(p)), lambda k, v: F.substr(k, F.lit(len(p) + 1)))
    said = F.lower(F.try_element_at("_f", F.lit("label_meta.reviewed"))).isin("true", "1", "yes")
    special = {"sample_id", "condition", "reference", "sources", "reviewed"}
    out = {c: F.coalesce(F.try_element_at("_f", F.lit(c)), F.col(c)) for c, kind in samples.dtypes if c not in special and kind == "string"}
    out |= {m: _over(F.col(m), part(f"{m}.")) for m in ("condition", "reference")}
    out["sources"] = _over(F.col("sources"), F.transform_values("_f", lambda k, v: F.lit("human")))
    out["reviewed"] = F.when(F.col("_r"), True).otherwise(F.coalesce(said, F.col("reviewed")))
    kept = [c for c in samples.columns if c not in out]
    return rows.select(*kept, *[c.alias(n) for n, c in out.items()], F.col("_by.annotator").alias("annotator"))


def dialogue_turns(turns: DataFrame, of: str = "all", most: int = 8, key: tuple[str, ...] = ("benchmark", "speaker"), order: str = "turn_id") -> DataFrame:
    """turns (audio, answer, tool_call, is_clarification) of a view with the up to `most` turns before each as messages,
    user then assistant, and their capability. Turns outside the view still count as history. A speaker is one task."""
    called, clarified = F.col("tool_call").isNotNull(), F.coalesce("is_clarification", F.lit(False))
    views = {"all": F.lit(True), "dialogue": ~called, "tool_call": called, "clarification": clarified}
    if of not in views:
        raise ValueError(f"no view {of}")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))
    both = F.array(message("user", F.col("audio")), message("assistant", F.col("answer")))
    before = F.collect_list(both).over(Window.partitionBy(*key).orderBy(order).rowsBetween(-most, -1))
    messages = F.flatten(before) if most else F.slice(both, 1, 0)
    tools = called & F.lit(of != "clarification")
    capability = F.when(tools, "tool_call").when(clarified, "clarification").otherwise("multi_turn_dialogue")
    return turns.withColumns({"messages": messages, "capability": capability}).filter(views[of])


_SLOT = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def rendered(rows: DataFrame, template: str) -> Column:
    """A template with {{name}} slots as one Column; a name that the rows lack is an error, a null value prints as None."""
    parts, at = [], 0
    for m in _SLOT.finditer(template):
        if m[1] not in rows.columns:
            raise ValueError(f"the template needs {m[1]}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit("None"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def majority(votes: Column) -> Column:
    """The vote given most often, in lower case; no where several are; null without votes."""
    low = F.filter(F.transform(votes, lambda v: F.lower(T.strip(v))), lambda v: v.isNotNull())
    counted = F.transform(F.array_distinct(low), lambda v: F.struct(F.size(F.filter(low, lambda w: w == v)).alias("n"), v.alias("v")))
    return T.let(counted, lambda c: T.let(F.array_max(F.transform(c, lambda x: x["n"])), lambda top: T.let(F.filter(c, lambda x: x["n"] == top), lambda best: F.when(F.size(best) == 1, best[0]["v"]).when(F.size(best) > 1, "no"))))
