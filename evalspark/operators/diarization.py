"""Speakers in time: segments from model output, diarization error, attribution error."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from evalspark.functions.assignment import assignment
from evalspark.functions.process import extract_json
from evalspark.functions.text_udf import edits

SEGMENT = "array<struct<start: double, end: double, speaker: string>>"
_ALIASED = "array<struct<start: double, start_time: double, begin: double, end: double, end_time: double, duration: double, speaker: string, speaker_id: string, label: string>>"


def segments(text: Column, seconds: Column | None = None) -> Column:
    """Segments of a model's answer: those of its JSON (a list, or under `segments`) by any of their field names, else the
    complete objects of a truncated one; clipped to the audio, of positive length, speakers in lower case."""
    value = extract_json(text)
    whole = F.coalesce(F.try_variant_get(value, "$.segments", "string"), F.when(F.schema_of_variant(value).startswith("ARRAY"), F.to_json(value)), F.when(F.schema_of_variant(value).startswith("OBJECT"), F.concat(F.lit("["), F.to_json(value), F.lit("]"))))
    pieces = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), 0), ","), F.lit("]"))
    truncated = F.length(F.replace(text, F.lit("{"), F.lit(""))) < F.length(F.replace(text, F.lit("}"), F.lit("")))
    rows = F.from_json(F.when(truncated | whole.isNull(), pieces).otherwise(whole), _ALIASED)
    start = lambda s: F.coalesce(s["start"], s["start_time"], s["begin"])
    end = lambda s: F.coalesce(s["end"], s["end_time"], start(s) + s["duration"])
    last = lambda s: F.least(end(s), seconds) if seconds is not None else end(s)
    who = lambda s: F.lower(F.trim(F.coalesce(s["speaker"], s["speaker_id"], s["label"])))
    made = F.transform(rows, lambda s: F.struct(F.greatest(start(s), F.lit(0.0)).alias("start"), last(s).alias("end"), who(s).alias("speaker")))
    return F.coalesce(F.filter(made, lambda s: (s["end"] > s["start"]) & s["speaker"].isNotNull()), F.array().cast(SEGMENT))


def merged(value: Column, gap: float = 1e-3) -> Column:
    """Segments in order, each joined to the one before it where the speaker is the same and the gap is small."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["speaker"].alias("speaker"))))
        near = (last["speaker"] == s["speaker"]) & (s["start"] <= last["end"] + gap)
        return F.when((F.size(done) > 0) & near, joined).otherwise(F.concat(done, F.array(s)))

    ordered = F.array_sort(value)
    return F.when(F.size(ordered) < 2, ordered).otherwise(F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), step))


Gain = dict[tuple[str, str], float]


def best_mapping(predicted: list[str], reference: list[str], gain: Gain) -> dict[str, str]:
    """Predicted speakers to reference speakers, by the greatest summed gain, exactly for any number of them; of several
    such mappings the first in order counts. Speakers beyond the reference's are mapped to none ("")."""
    if not predicted or not reference:
        return {}
    padded = reference + [""] * max(0, len(predicted) - len(reference))
    best = assignment([[-gain.get((p, r), 0.0) for r in padded] for p in predicted])
    return {p: padded[k] for p, k in zip(predicted, best, strict=True)}


def greedy_mapping(predicted: list[str], reference: list[str], gain: Gain) -> dict[str, str]:
    """Each predicted speaker to the reference speaker of the greatest gain, several to one if so: the cheap choice that
    some scorers make for many speakers."""
    return {p: max(reference, key=lambda r: gain.get((p, r), 0.0)) for p in predicted} if reference else {}


def error_durations(reference: list[dict], predicted: list[dict], mapped: Callable[[list[str], list[str], Gain], dict[str, str]] = best_mapping) -> tuple[float, float]:
    """Seconds in which the sets of active speakers differ, and seconds with a reference speaker."""
    marks = sorted({s[k] for s in reference + predicted for k in ("start", "end")})
    active = lambda side, t: tuple(sorted(s["speaker"] for s in side if s["start"] <= t < s["end"]))
    spans = [(b - a, active(reference, (a + b) / 2), active(predicted, (a + b) / 2)) for a, b in pairwise(marks)]
    gain: dict[tuple[str, str], float] = defaultdict(float)
    for length, r, p in spans:
        if len(r) == len(p) == 1:
            gain[p[0], r[0]] += length
    mapping = mapped(sorted({s["speaker"] for s in predicted}), sorted({s["speaker"] for s in reference}), gain)
    wrong = sum(length for length, r, p in spans if tuple(sorted(mapping.get(x, x) for x in p)) != r)
    return wrong, sum(length for length, r, _ in spans if r)


_DURATIONS = StructType([StructField("error", DoubleType()), StructField("reference", DoubleType())])


@F.arrow_udf(returnType=_DURATIONS)
def der_durations(reference: pa.Array, predicted: pa.Array) -> pa.Array:
    """error_durations of two columns of segments; the rate of a corpus is the ratio of the sums."""
    pairs = [error_durations(r or [], p or []) for r, p in zip(reference.to_pylist(), predicted.to_pylist(), strict=True)]
    return pa.array([{"error": float(e), "reference": float(n)} for e, n in pairs], pa.struct([("error", pa.float64()), ("reference", pa.float64())]))


def attribution(reference: list[dict], predicted: list[dict]) -> tuple[float, float]:
    """Mean word error rate per speaker under the best mapping of speakers, and the share of utterances (by id) that are
    given to the right one."""
    said: list[dict[str, list[str]]] = []
    for side in (reference, predicted):
        by: dict[str, list[str]] = defaultdict(list)
        for u in side:
            by[u["speaker"]].extend(u["text"].lower().split())
        said.append(by)
    refs, preds = sorted(said[0]), sorted(said[1])
    if not refs or not preds:
        return 1.0, 0.0
    size = max(len(refs), len(preds))
    preds += [f"\x00{k}" for k in range(size - len(preds))]
    refs += [""] * (size - len(refs))

    def cost(p: str, r: str) -> float:
        want, got = said[0].get(r, []), said[1].get(p, [])
        return float(bool(got)) if not want else edits(want, got) / len(want) if got else 1.0

    table = {(p, r): cost(p, r) for p in preds for r in set(refs)}
    best = [refs[k] for k in assignment([[table[p, r] for r in refs] for p in preds])]
    mapping, of = dict(zip(preds, best, strict=True)), {u["id"]: u["speaker"] for u in reference}
    compared = [mapping.get(u["speaker"]) == of[u["id"]] for u in predicted if u["id"] in of]
    return sum(table[pair] for pair in zip(preds, best, strict=True)) / size, sum(compared) / len(compared) if compared else 0.0


UTTERANCES = ArrayType(StructType([StructField(c, StringType()) for c in ("id", "speaker", "text")]))


@F.arrow_udf(returnType=StructType([StructField("cpwer", DoubleType()), StructField("accuracy", DoubleType())]))
def attribution_scores(reference: pa.Array, predicted: pa.Array) -> pa.Array:
    """attribution of two columns of utterances (id, speaker, text)."""
    pairs = [attribution(r or [], p or []) for r, p in zip(reference.to_pylist(), predicted.to_pylist(), strict=True)]
    return pa.array([{"cpwer": c, "accuracy": a} for c, a in pairs], pa.struct([("cpwer", pa.float64()), ("accuracy", pa.float64())]))


def utterances(text: Column) -> Column:
    """Utterances of a model's answer: a list, or under `utterances`; repaired where the key of the speaker is missing."""
    repaired = F.regexp_replace(text, r'\{\s*"((?:speaker|spk)[_-]?\d+)"\s*,\s*"text"\s*:', r'{"speaker": "$1", "text":')
    value = extract_json(repaired)
    whole = F.coalesce(F.try_variant_get(value, "$.utterances", "string"), F.when(F.schema_of_variant(value).startswith("ARRAY"), F.to_json(value)))
    pieces = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(repaired, F.lit(r"\{[^{}]*\}"), 0), ","), F.lit("]"))
    rows = F.from_json(F.coalesce(whole, pieces), "array<struct<id: string, utterance_id: string, speaker: string, speaker_id: string, text: string, transcript: string>>")
    made = F.transform(rows, lambda u, k: F.struct(F.coalesce(u["id"], u["utterance_id"], k.cast("string")).alias("id"), F.lower(F.trim(F.coalesce(u["speaker"], u["speaker_id"]))).alias("speaker"), F.trim(F.coalesce(u["text"], u["transcript"])).alias("text")))
    return F.coalesce(F.filter(made, lambda u: (u["speaker"] != "") & (u["text"] != "")), F.array().cast("array<struct<id: string, speaker: string, text: string>>"))
