"""Records of the first schema as records of the second; best of several references; speech windows; run summaries."""

import json

from pyspark.sql import functions as F

from evalspark.functions.text_udf import best_scores
from evalspark.operators import adapter, cube, intervals
from evalspark.sources import events

TASKS = {"spoken_agentic_interaction": ["tool_call"], "speaker_attribution": ["diarization"]}


def adapted(spark, records):
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "k long, j string").select("k", F.parse_json("j").alias("r"))
    return adapter.v1_to_v2(rows, "r", TASKS).orderBy("k").collect()


def test_v1_to_v2_keeps_what_is_ambiguous_and_guesses_nothing(spark):
    legacy = {"task": "asr_task", "capability": "asr", "scenario": "phone", "condition": {"acoustic": "hum", "spatial": "roof", "speaker": "two", "device": "watch"}, "use_bucket": "formal_subscores", "split": "Valid", "metadata": {"metrics": ["x"], "city": "b", "snr_bucket": ""}, "label_meta": {"sources": {"condition.device": "human"}}}
    full = {"task": "speaker_attribution", "capability": "diarization", "scenario": {"primary": "home", "secondary": "kitchen"}, "use_bucket": "formal_subscores", "condition": {"acoustic": "overlap_speech", "spatial": "far_field", "speaker": "single_speaker", "device": "phone"}, "metadata": {"snr_bucket": "high"}}
    odd = [{"task": "runtime", "capability": "latency"}, {"task": "x", "capability": "y"}, {"task": "agent", "capability": "z"}, {"task": "speech_output", "capability": "prosody", "condition": "none"}, {}]
    a, b, runtime, lost, agent, speech, empty = adapted(spark, [legacy, full, *odd])
    assert (a.task, a.capability, a.capability_protocol, a.primary, a.split, a.use_bucket, a.error) == ("speech_recognition_transcription", "asr", "speech_recognition_transcription/asr@1", "unknown", "dev", "coverage_debt", None)
    assert a.metadata == {"city": "b", "device_type": "watch", "recording_setup": "unknown", "noise_type": "unknown", "snr_bucket": None, "speaker_count": None, "overlap_level": "unknown"}
    assert tuple(a.provenance["device_type"]) == ("human", 0.6) and tuple(a.provenance["noise_type"]) == ("unknown", 0.0) and "snr_bucket" not in a.provenance
    assert a.warnings == ["legacy spatial value retained only in legacy: roof", "ambiguous legacy acoustic value retained: hum", "legacy speaker value retained only in legacy: two", "legacy scenario=phone migrated to metadata.device_type; scenario left unknown", "formal_subscores downgraded to coverage_debt because V2 attributes are unknown"]
    assert (b.task, b.primary, b.secondary, b.use_bucket, b.warnings) == ("speaker_attribution", "home", "kitchen", "formal_subscores", [])
    assert b.metadata == {"device_type": "phone", "recording_setup": "far_field", "noise_type": "speech", "snr_bucket": "high", "speaker_count": "1", "overlap_level": "mild"} and tuple(b.provenance["overlap_level"]) == ("legacy_adapter", 0.4)
    assert runtime.task is None and "measurement family" in runtime.error and lost.error == "cannot map legacy task/capability without evidence: x/y"
    assert agent.task == "spoken_agentic_interaction" and (speech.task, speech.capability) == ("speech_generation_delivery", "speech_generation")
    assert speech.warnings == ["legacy speech_output capability retained as an evaluation dimension", "legacy condition was not an object", "scenario has no supported evidence and remains unknown"]
    assert empty.task is None and empty.use_bucket == "diagnostic_evidence" and empty.split == "test"


def test_best_of_references():
    assert best_scores("The Cat!", ["a dog", "the  cat"]) == {"text_f1": 1.0, "exact_match": 1.0, "rouge_l": 1.0}
    assert best_scores("b a c", ["a b", None]) == {"text_f1": 0.8, "exact_match": 0.0, "rouge_l": 0.4}
    assert best_scores(None, None) == best_scores("", []) == {"text_f1": 1.0, "exact_match": 1.0, "rouge_l": 1.0}
    assert best_scores("你好吗", ["好", "x"])["text_f1"] == 0.5


def test_speech_windows_match_plain_ones(spark):
    import random

    rng = random.Random(4)
    rows = [(k % 3, f"s{rng.randrange(3)}", a := rng.uniform(0, 150), a + rng.uniform(0.1, 45)) for k in range(60)] + [(9, "s", 0.0, 29.0)]
    got = {(r.m, r.window_start): (r.speakers, round(r.speech, 6)) for r in intervals.speech_windows(spark.createDataFrame(rows, "m int, speaker string, start double, end double"), ["m"]).collect()}
    plain = {}
    for m in (0, 1, 2, 9):
        mine, t = [r[1:] for r in rows if r[0] == m], 0.0
        while t + 30 <= max(e for _, _, e in mine) + 1e-6:
            by = {}
            for who, a, b in mine:
                if (s := min(b, t + 30) - max(a, t)) > 0:
                    by[who] = by.get(who, 0) + s
            if len(by) >= 2 and sum(by.values()) >= 4:
                plain[m, t] = (len(by), round(sum(by.values()), 6))
            t += 20
    assert got == plain and len(got) > 10


def test_run_summary_and_difference_of_cubes(spark):
    samples = spark.createDataFrame([(k,) for k in range(5)], "id long")
    log = spark.createDataFrame([(0, "eval"), (1, "error"), (2, "skipped"), (3, "skipped"), (3, "error"), (9, "error")], "id long, type string")
    assert tuple(events.run_summary(samples, log).first()) == (5, 2, 1, 0.4, 40.0, 0.2)
    assert tuple(events.run_summary(samples.limit(0), log).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    kind = "slice string, label string, metric string, value double"
    a, b = spark.createDataFrame([("s", "l", "m", 1.0), ("s", "l", "n", 2.0)], kind), spark.createDataFrame([("s", "l", "m", 1.0005), ("s", "l", "o", 3.0)], kind)
    assert sorted(map(tuple, cube.difference(a, b, 0.001).collect())) == [("s", "l", "n", 2.0, None, None), ("s", "l", "o", None, 3.0, None)]
