"""Records of the first schema as records of the second, by tables of what maps to what.

Nothing is guessed: a value without a counterpart stays behind with a warning, a task without one is an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.schemas import at, held_readers, held_values

# Tasks by capability, noises, scenarios, splits, and what sources of labels are called.
RECOGNITION = ("asr", "long_form_asr", "speech_translation", "code_switch")
UNDERSTANDING = ("audio_reasoning", "audio_caption", "sound_event", "acoustic_scene", "paralinguistic", "paralinguistic_recognition", "qa", "meeting_summary", "meeting_qa", "timeline_query", "todo_extraction")
SPEAKERS = ("speaker_count", "speaker_verification", "diarization", "speaker_attribution", "target_speaker", "spoof_detection")
AGENTS = ("instruction_following", "tool_call", "navigation", "calendar", "reminder", "phone_message", "music_control", "vehicle_control", "translation_instruction", "multi_turn_dialogue", "clarification", "interruption")
TASKS = ((RECOGNITION, "", "speech_recognition_transcription"), (UNDERSTANDING, "", "audio_speech_understanding"), (SPEAKERS, "speaker", "speaker_attribution"), (AGENTS, "agent", "spoken_agentic_interaction"))
NOISES = {"clean": "clean", "traffic_noise": "traffic", "crowd_noise": "crowd", "music_noise": "music", "wind_noise": "wind", "reverb": "reverberation", "overlap_speech": "speech"}
SCENARIOS = ("home", "vehicle", "meeting", "public", "outdoor")
SPLITS = {"validation": "dev", "valid": "dev", "eval": "test", "evaluation": "test", "all": "test", "mini": "test", "smoke": "test"}
SOURCES = {"native": "dataset_native", "rule": "legacy_adapter", "acoustic_model": "acoustic_model", "llm_draft": "llm_draft", "knowledge_verified": "verified_derived", "knowledge_revise": "verified_derived", "knowledge_flagged": "unknown", "human": "human"}
CORE = ("device_type", "recording_setup", "noise_type", "snr_bucket", "speaker_count", "overlap_level")

#: What of a record of the first schema is looked at.
PATHS = ("$.task", "$.task_name", "$.capability", "$.scenario", "$.scenario.primary", "$.scenario.secondary", "$.condition", *[f"$.condition.{k}" for k in ("acoustic", "spatial", "speaker", "device")], "$.use_bucket", "$.split")


def _map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _mapped(task: Column, capability: Column, taxonomy: Mapping[str, Sequence[str]]) -> tuple[Column, Column, Column]:
    """(task, capability, whether it is a family of measurements or has no counterpart)."""
    known = [F.lit(x) for t, cs in taxonomy.items() for x in (t, F.array(*map(F.lit, cs)))]
    kept = F.coalesce(F.array_contains(F.create_map(*known)[task], capability), F.lit(False)) if known else F.lit(False)
    found = F.when(kept, task).when(task == "runtime", F.lit(None))
    for capabilities, old, new in TASKS:
        found = found.when(capability.isin(*capabilities) | ((task == old) if old else F.lit(False)), new)
    found = found.when(task == "speech_output", "speech_generation_delivery")
    named = F.when(~kept & (found == "speech_generation_delivery"), "speech_generation").when(~kept & (capability == "paralinguistic"), "paralinguistic_recognition").otherwise(capability)
    return found, named, kept


def v1_to_v2(rows: DataFrame, record: str, taxonomy: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows with task, capability, capability_protocol, primary, secondary, metadata (a map of texts), provenance (a map
    from a core field to its source and confidence), use_bucket, split, warnings and error of a VARIANT column.

    taxonomy: the capabilities of each task of the second schema. A record whose task has no counterpart has an error,
    and no task; a formal record with unknown core metadata or scenario is downgraded to coverage_debt.
    """
    r, added = F.col(record), ("_held", "_mine", "_sources")
    own = F.coalesce(F.try_variant_get(r, "$.metadata", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    # what the columns below name again and again is read once per row
    rows = rows.withColumns({
        "_held": held_values(r, PATHS), "_mine": F.map_filter(F.transform_values(own, lambda _, v: at(v, "$")), lambda k, _: k != "metrics"),
        "_sources": F.coalesce(F.try_variant_get(r, "$.label_meta.sources", "map<string,string>"), F.create_map().cast("map<string,string>")),
    })
    mine, sources = F.col("_mine"), F.col("_sources")
    there_at, kind = held_readers(F.col("_held"), PATHS)
    text = lambda p: F.coalesce(there_at(p), F.lit(""))
    old_task, old_capability = F.coalesce(there_at("$.task"), there_at("$.task_name"), F.lit("")), text("$.capability")
    task, capability, kept = _mapped(old_task, old_capability, taxonomy)
    origin = lambda key: F.coalesce(_map(SOURCES)[F.lower(sources[key])], F.lit("legacy_adapter"))
    condition = lambda k: there_at(f"$.condition.{k}")
    acoustic, spatial, speaker, scenario = condition("acoustic"), condition("spatial"), condition("speaker"), there_at("$.scenario")
    whole = kind("$.scenario").startswith("OBJECT")
    phone = F.coalesce(~whole & (scenario == "phone"), F.lit(False))
    # (field, value that the record's conditions give it, where that comes from, confidence)
    rules = (
        ("device_type", condition("device"), "condition.device", 0.6), ("device_type", F.when(phone, "phone"), "scenario", 0.6), ("recording_setup", F.when(spatial.isin("near_field", "far_field"), spatial), "condition.spatial", 0.6),
        ("noise_type", _map(NOISES)[acoustic], "condition.acoustic", 0.6), ("speaker_count", F.when(speaker == "single_speaker", "1"), "condition.speaker", 0.6), ("overlap_level", F.when(acoustic == "overlap_speech", "mild"), "condition.acoustic", 0.4),
    )
    values, origins = [], []
    for name in CORE:
        given = [(v, F.struct(origin(key).alias("source"), F.lit(sure).alias("confidence"))) for n, v, key, sure in rules if n == name]
        there = F.map_contains_key(mine, F.lit(name))
        fired = F.coalesce(*[v for v, _ in given], F.lit(None).cast("string"))
        default = F.lit(None).cast("string") if name == "speaker_count" else F.lit("unknown")
        values += [F.lit(name), F.coalesce(mine[name], fired, F.when(~there, default))]
        first = F.coalesce(*[F.when(v.isNotNull(), s) for v, s in given], F.when(~there, F.struct(F.lit("unknown").alias("source"), F.lit(0.0).alias("confidence"))))
        origins += [F.lit(name), first]
    metadata = F.map_concat(F.map_filter(mine, lambda k, _: ~k.isin(*CORE)), F.create_map(*values))
    primary = F.when(whole, F.coalesce(there_at("$.scenario.primary"), F.lit("unknown"))).when(scenario.isin(*SCENARIOS), scenario).otherwise("unknown")
    asked = F.coalesce(there_at("$.use_bucket"), F.lit("diagnostic_evidence"))
    unknown = F.greatest(*[F.coalesce(values[2 * k + 1], F.lit("unknown")) == "unknown" for k in range(len(CORE))])
    lowered = (asked == "formal_subscores") & ((primary == "unknown") | unknown)
    split = F.lower(F.coalesce(there_at("$.split"), F.lit("test")))
    say = lambda when, *words: F.when(when, F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]))
    warnings = F.array_distinct(F.array_compact(F.array(
        say(~kept & (task == "speech_generation_delivery"), "legacy speech_output capability retained as an evaluation dimension"),
        say(there_at("$.condition").isNotNull() & ~kind("$.condition").startswith("OBJECT"), "legacy condition was not an object"),
        say(spatial.isNotNull() & ~spatial.isin("near_field", "far_field"), "legacy spatial value retained only in legacy: ", spatial),
        say(acoustic.isNotNull() & _map(NOISES)[acoustic].isNull(), "ambiguous legacy acoustic value retained: ", acoustic),
        say(speaker.isNotNull() & (speaker != "single_speaker"), "legacy speaker value retained only in legacy: ", speaker),
        say(phone, "legacy scenario=phone migrated to metadata.device_type; scenario left unknown"),
        say(~whole & ~phone & ~F.coalesce(scenario.isin(*SCENARIOS), F.lit(False)), "scenario has no supported evidence and remains unknown"),
        say(lowered, "formal_subscores downgraded to coverage_debt because V2 attributes are unknown"),
    )))
    error = F.when(~kept & (old_task == "runtime"), "legacy runtime Task is a measurement family and has no canonical V2 Task")
    error = error.when(task.isNull(), F.concat(F.lit("cannot map legacy task/capability without evidence: "), old_task, F.lit("/"), old_capability))
    return rows.withColumns({
        "task": task, "capability": F.when(task.isNotNull(), capability), "capability_protocol": F.concat(task, F.lit("/"), capability, F.lit("@1")),
        "primary": primary, "secondary": F.when(whole, there_at("$.scenario.secondary")), "metadata": metadata, "provenance": F.map_filter(F.create_map(*origins), lambda _, v: v.isNotNull()),
        "use_bucket": F.when(lowered, "coverage_debt").otherwise(asked), "split": F.coalesce(_map(SPLITS)[split], split), "warnings": warnings, "error": error,
    }).drop(*added)
