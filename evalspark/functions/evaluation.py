"""Per-row evaluators, Column to Column: matching, choices, classification, gates, runtime fields, judge scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions import text_udf as U
from evalspark.functions.process import extract_json
from evalspark.functions.text import first_present, let, nz, squeeze, strip, words

# Words for true and false.
TRUE_WORDS = ("1", "true", "yes", "y", "是", "需要", "允许", "响应", "执行", "authorized")
FALSE_WORDS = ("0", "false", "no", "n", "否", "不需要", "拒绝", "忽略", "不执行", "unauthorized")
#: ASCII punctuation as a regular expression.
PUNCTUATION = "[!-/:-@\\[-`{-~]"


def canonical(value: Column) -> Column:
    """A scalar as text: NFKC, lower case, white space squeezed; whole floats lose their fraction; missing is empty."""
    t = F.coalesce(value.cast("string"), F.lit(""))
    whole = F.when(t.rlike("^-?\\d+\\.0+$"), F.regexp_replace(t, "\\.0+$", "")).otherwise(t)
    return squeeze(F.lower(strip(U.nfkc(whole))))


def truth(value: Column) -> Column:
    """A text as a boolean: a word for true or false, else the first such word in it, else null."""
    yes, no = (F.array(*map(F.lit, w)) for w in (TRUE_WORDS, FALSE_WORDS))
    judged = lambda w: F.when(F.array_contains(yes, w), True).when(F.array_contains(no, w), False)

    def first(t: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(t, F.lit("(?U)\\w+"), 0), judged), lambda x: x.isNotNull())
        return F.coalesce(judged(t), F.get(found, F.lit(0)))

    return let(canonical(value), first)


def exact_match(predicted: Column, reference: Column, numeric: bool = False) -> Column:
    """Equality without outer white space; as numbers where the reference is one (no number: no match)."""
    same = predicted.try_cast("double") == reference.try_cast("double") if numeric else strip(predicted) == strip(reference)
    return F.coalesce(same, F.lit(False)).cast("int")


def qa_normal(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles."""
    return F.array_join(F.filter(words(F.regexp_replace(F.lower(text), PUNCTUATION, "")), lambda w: ~w.isin("a", "an", "the")), " ")


def qa_match(predicted: Column, references: Column) -> Column:
    """Whether any of an array of references equals the prediction, both normalised."""
    return F.exists(F.transform(references, qa_normal), lambda r: r == qa_normal(predicted)).cast("int")


def qa_contains(predicted: Column, references: Column) -> Column:
    """Whether the tokens of any reference stand in a row in the prediction, or its letters do, marks aside."""
    token = F.lit("[\\p{L}\\p{N}\\p{M}]+|[^\\p{Z}\\p{C}]")
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(t), token, 0), " "), F.lit(" "))
    bare = lambda t: F.regexp_replace(F.lower(t), "(?U)[!-/:-@\\[-`{-~。，、；：？！「」『』（）【】《》—…·\\s]", "")
    # all normalised as one text, which keeps the Arrow function outside the loops
    normal = U.nfd(F.concat_ws("\x00", predicted, F.array_join(references, "\x00")))

    def judged(texts: Column) -> Column:
        sides = F.transform(texts, lambda t: F.struct(spaced(t).alias("s"), bare(t).alias("b")))

        def found(x: Column) -> Column:
            p = F.element_at(x, 1)
            return F.exists(F.slice(x, 2, F.size(x)), lambda r: ((F.trim(r["s"]) != "") & F.contains(p["s"], r["s"])) | ((r["b"] != "") & F.contains(p["b"], r["b"])))

        return let(sides, found)

    return let(F.split(normal, "\x00"), judged).cast("int")


def normal_choice(text: Column) -> Column:
    return squeeze(F.replace(F.lower(strip(text)), F.lit("-"), F.lit(" ")))


def choice_letter(predicted: Column, n_choices: Column) -> Column:
    """The letter at the start of a prediction, else the one before its last character (`… is A.`); else null."""
    letters = F.transform(F.sequence(F.lit(0), n_choices - 1), lambda i: F.char(i + 65))
    p = strip(predicted)
    first, late = F.substring(p, 1, 1), F.substring(p, -2, 1)
    usable = p.isNotNull() & (p != "") & (p != "None")
    return F.when(usable & F.array_contains(letters, first), first).when(usable & (F.length(p) > 1) & F.array_contains(letters, late), late)


def choice_match(predicted: Column, reference: Column, choices: Column) -> Column:
    """1 or 0 by the letter of the choice that equals the reference; null where the prediction names no letter."""
    letter = choice_letter(predicted, F.size(choices))
    # of equal choices the last one's letter counts
    at = F.size(choices) - F.array_position(F.reverse(F.transform(choices, normal_choice)), normal_choice(reference))
    of = F.when(F.array_contains(F.transform(choices, normal_choice), normal_choice(reference)), F.char(at + 65))
    return F.when(letter.isNotNull(), F.coalesce((letter == of).cast("int"), F.lit(0)))


def choice_words_match(predicted: Column, reference: Column, choices: Column) -> Column:
    """All words of the reference stand in the prediction, and none that only wrong choices have."""
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("(?U)\\w+"), 0))

    def judged(s: Column) -> Column:
        p, a = s["p"], s["a"]
        wrong = F.flatten(F.transform(F.transform(choices, tokens), lambda c: F.array_except(c, a)))
        return (F.size(p) > 0) & (F.size(F.array_except(a, p)) == 0) & ~F.coalesce(F.arrays_overlap(p, wrong), F.lit(False))

    return let(F.struct(tokens(predicted).alias("p"), tokens(reference).alias("a")), judged).cast("int")


def template_choice(predicted: Column, templates: tuple[str, ...], letters: str = "abcd") -> Column:
    """The letter of the first template that the prediction holds with it, templates outermost; else the letter that
    begins it; else null. A template has [CHOICE] where the letter stands."""
    t = F.regexp_replace(F.lower(predicted), "^<[123]>\\s*", "")
    filled = F.array(*[F.struct(F.lit(x.replace("[CHOICE]", c)).alias("said"), F.lit(c.upper()).alias("c")) for x in templates for c in letters])
    hit = F.get(F.filter(filled, lambda x: F.contains(t, x["said"])), F.lit(0))["c"]
    start = nz(F.regexp_extract(t, f"^([{letters}])(?:$|[.,:)])", 1))
    return F.coalesce(hit, F.upper(start))


# The usual wordings of a chosen letter.
CHOICE_TEMPLATES = (
    "答案是[CHOICE]", "答案是:[CHOICE]", "答案是：[CHOICE]", "答案是 [CHOICE]", "答案是选项[CHOICE]", "答案应该是[CHOICE]", "答案选[CHOICE]",
    "answer is: **[CHOICE]", "answer is **[CHOICE]", "the answer is '[CHOICE]'", "[CHOICE] is the best answer", "the answer is [CHOICE]",
    "the correct answer is [CHOICE]", "would select [CHOICE]", "would choose [CHOICE]", "would select option [CHOICE]", "would choose option [CHOICE]",
)


def json_field(text: Column, *keys: str) -> Column:
    """The first of the keys that the JSON inside a text has a value for, as text; null for none or no JSON."""
    value = extract_json(text)
    return first_present(*[F.try_variant_get(value, f"$.{k}", "string") for k in keys])


def class_label(predicted: Column) -> Column:
    """The label that a prediction names: a field of its JSON, or the text itself."""
    return canonical(F.coalesce(json_field(predicted, "label", "answer", "class", "scene_label", "value"), predicted))


def class_prediction(predicted: Column, reference: Column) -> Column:
    """class_label; where the reference is a letter from A to D, the first such letter that stands alone."""
    alone = F.lower(nz(F.regexp_extract(F.upper(predicted), "(?<![A-Za-z])([A-D])(?![A-Za-z])", 1)))
    return F.when(F.upper(canonical(reference)).isin("A", "B", "C", "D"), F.coalesce(alone, class_label(predicted))).otherwise(class_label(predicted))


def gate(predicted: Column, expected: Column, *keys: str) -> dict[str, Column]:
    """valid, acc, false_accept (null unless no was expected) and false_reject (null unless yes was)."""
    said = F.coalesce(truth(F.coalesce(json_field(predicted, *keys), predicted)), F.when(F.trim(F.coalesce(predicted, F.lit(""))) == "", False))
    want = truth(expected)
    valid = said.isNotNull() & want.isNotNull()
    return {
        "valid": valid.cast("int"),
        "acc": F.coalesce(valid & (said == want), F.lit(False)).cast("int"),
        "false_accept": F.when(~want, F.coalesce(said, F.lit(True)).cast("int")),
        "false_reject": F.when(want, F.coalesce(~said, F.lit(True)).cast("int")),
    }


def speaker_count(predicted: Column, expected: Column) -> dict[str, Column]:
    """valid where the prediction (or its count) is a whole number, and whether it is the expected one."""
    n = F.coalesce(json_field(predicted, "count", "speaker_count"), predicted).try_cast("int")
    return {"valid": n.isNotNull().cast("int"), "acc": F.coalesce(n == expected.try_cast("int"), F.lit(False)).cast("int")}


def verification(predicted: Column, expected: Column, threshold: float = 0.5) -> dict[str, Column]:
    """score (a number, or 1 and 0 for words), label, and whether score >= threshold agrees with the label."""
    said = F.coalesce(json_field(predicted, "score", "similarity", "same_speaker"), predicted)
    word, want = truth(said), truth(expected)
    number = said.try_cast("double")
    agreed = F.when(number.isNotNull(), number >= threshold).otherwise(word)
    return {
        "score": F.coalesce(number, F.when(word, 1.0).otherwise(0.0)),
        "label": F.coalesce(want, F.lit(False)).cast("int"),
        "acc": F.coalesce(agreed == want, F.lit(False)).cast("int"),
        "valid": (agreed.isNotNull() & want.isNotNull()).cast("int"),
    }


#: Runtime fields and where they may stand (fixed values).
RUNTIME_FIELDS = {
    "latency_ms": ("runtime.latency_ms", "latency_ms", "latency"),
    "first_token_latency_ms": ("runtime.first_token_latency_ms", "first_token_latency_ms", "ttft_ms"),
    "first_audio_chunk_latency_ms": ("runtime.first_audio_chunk_latency_ms", "first_audio_chunk_latency_ms", "ttfa_ms"),
    "rtf": ("runtime.rtf", "rtf", "RTF"),
    "memory_peak_mb": ("runtime.memory_peak_mb", "memory_peak_mb", "peak_memory_mb"),
    "cpu_usage": ("runtime.cpu_usage", "cpu_usage"),
    "npu_usage": ("runtime.npu_usage", "npu_usage"),
    "power_watts": ("runtime.power_watts", "power_watts", "power"),
}


def runtime_fields(data: Column) -> dict[str, Column]:
    """Runtime values of a JSON text by their names or aliases; negative ones and what is no number are missing."""
    read = lambda names: first_present(*[F.get_json_object(data, f"$.{n}") for n in names]).try_cast("double")
    out = {name: F.when(read(aliases) >= 0, read(aliases)) for name, aliases in RUNTIME_FIELDS.items()}
    flag = lambda *names: F.coalesce(truth(first_present(*[F.get_json_object(data, f"$.{n}") for n in names])), F.lit(False)).cast("int")
    return out | {"timeout": flag("runtime.timeout", "timeout"), "failure": flag("runtime.failure", "failure", "failed")}


def rtf(latency_ms: Column, audio_seconds: Column) -> Column:
    """Real-time factor; null without a positive duration."""
    return F.when(audio_seconds > 0, F.try_divide(latency_ms / 1000.0, audio_seconds))


def failure_type(error: Column, stage: Column) -> Column:
    """The class of a failure by the error's kind and the stage in which it came."""
    contract = error.isin("ValueError", "TypeError", "KeyError") & stage.isin("prompt", "post_process", "evaluation")
    return (
        F.when(error == "TimeoutError", "timeout")
        .when(error == "MemoryError", "resource_exhausted")
        .when(error == "FileNotFoundError", "input_unavailable")
        .when(error.isin("OSError", "ConnectionError", "PermissionError", "BrokenPipeError"), "infrastructure")
        .when(contract, "contract_violation")
        .when(stage == "inference", "model_runtime")
        .otherwise("internal")
    )


def output_error(predicted: Column, parser: Column) -> Column:
    """What is wrong with the shape of a prediction under its parser; null if nothing."""
    value = F.try_parse_json(predicted)
    nested = F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    audio = F.coalesce(nz(F.try_variant_get(value, "$.audio", "string")).isNotNull(), F.lit(False))
    wrong = (
        F.when(parser.isin("transcript_text@1", "answer_text@1"), F.when(F.trim(predicted) == "", "empty text"))
        .when(parser == "classification@1", F.when((F.trim(predicted) == "") | nested, "no scalar label"))
        .when(parser.isin("structured_json@1", "dialogue@1"), F.when(~nested, "no object or array"))
        .when(parser == "generated_audio@1", F.when(~audio & ~predicted.rlike("\\.(wav|flac|mp3|ogg)$"), "no audio"))
        .when(parser == "identity@0", F.lit(None))
        .otherwise("unknown parser")
    )
    return F.when(predicted.isNull(), "null").otherwise(wrong)


def error_rate_score(rate: Column) -> Column:
    """100 (1 - rate) up to a rate of one half, 0 beyond."""
    return F.when(rate <= 0.5, 100.0 * (1.0 - rate)).otherwise(0.0)


def vocal_state(text: Column) -> Column:
    """The state named after `the speaker is in the state of`; null where none is."""
    return nz(F.regexp_extract(text, "(?i)the speaker is in the state of\\s+([a-zA-Z]+)", 1))


def audio_path(text: Column) -> Column:
    """An audio path: the `audio` of a JSON text, else the first thing in the text that looks like one."""
    return F.coalesce(nz(F.get_json_object(text, "$.audio")), nz(F.regexp_extract(text, "([^\\s\"'<>]+\\.(?:wav|flac|mp3|ogg))", 1)))
