"""Post-processors of model output, Column to Column, and JSON extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import let, nz, squeeze, strip


def eliminate(text: Column, target: str) -> Column:
    return F.replace(text, F.lit(target), F.lit(""))


def force_stop(text: Column, target: str) -> Column:
    """What stands before the first target."""
    return F.substring_index(text, target, 1)


def extract_response(text: Column, target: str) -> Column:
    """What stands between the first and the second target; null where there is none."""
    parts = F.split_part(text, F.lit(target), F.lit(2))
    return F.when(F.contains(text, F.lit(target)), parts)


def strip_fence(text: Column) -> Column:
    """The inside of the first fenced block, else the text."""
    return F.coalesce(nz(F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)), text)


def extract_json(text: Column) -> Column:
    """Model output as VARIANT: a fenced block, the whole text, the outermost braces, the outermost brackets."""
    candidates = (strip_fence(text), text, nz(F.regexp_extract(text, "(?s)(\\{.*\\})", 1)), nz(F.regexp_extract(text, "(?s)(\\[.*\\])", 1)))
    return F.coalesce(*[F.try_parse_json(c) for c in candidates])


def json_extract(text: Column, key: str, default: str | None = None) -> Column:
    """A key of a JSON text as a string; text that is no JSON passes, a missing key gives the default."""
    found = F.get_json_object(text, f"$.{key}")
    return F.when(F.try_parse_json(text).isNull(), text).otherwise(F.coalesce(found, F.lit(default)))


def content_extract(text: Column) -> Column:
    """The `content` of a JSON answer, else the answer."""
    inner = strip_fence(text)
    return F.coalesce(F.get_json_object(inner, "$.content"), text)


# Patterns in the order in which they count; @ stands for the option letters. A list that glues
# `故选?\s*([@])` to the pattern behind it never finds either; they are two here.
OPTION_PATTERNS = (
    r"答案是?\s*([@])",
    r"答案是?\s*：\s*([@])",
    r"答案是?\s*:\s*([@])",
    r"答案是选项?\s*:\s*([@])",
    r"答案选项应?该?是\s*([@])",
    r"答案选项应?该?为\s*([@])",
    r"答案应该?是\s*([@])",
    r"答案应该?选\s*([@])",
    r"答案选项为?\s*：\s*([@])",
    r"答案选项为?\s+\(?\*?\*?([@])\*?\*?\)?",
    r"选项为?\s+\(?\*?\*?([@])\*?\*?\)?",
    r"答案选项是?\s*:\s*([@])",
    r"答案为\s*([@])",
    r"答案选\s*([@])",
    r"选择?\s*([@])",
    r"故选?\s*([@])",
    r"只有选?项?\s?([@])\s?是?对",
    r"只有选?项?\s?([@])\s?是?错",
    r"只有选?项?\s?([@])\s?不?正确",
    r"只有选?项?\s?([@])\s?错误",
    r"说法不?对选?项?的?是\s?([@])",
    r"说法不?正确选?项?的?是\s?([@])",
    r"说法错误选?项?的?是\s?([@])",
    r"([@])\s?是正确的",
    r"([@])\s?是正确答案",
    r"选项\s?([@])\s?正确",
    r"所以答\s?([@])",
    r"所以\s?([@][.。$]?$)",
    r"所有\s?([@][.。$]?$)",
    r"[\s，：:,]([@])[。，,\.]?$",
    r"[\s，,：:][故即]([@])[。\.]?$",
    r"[\s，,：:]因此([@])[。\.]?$",
    r"[是为。]\s?([@])[。\.]?$",
    r"因此\s?([@])[。\.]?$",
    r"显然\s?([@])[。\.]?$",
    r"答案是\s?(\S+)(?:。|$)",
    r"答案应该是\s?(\S+)(?:。|$)",
    r"答案为\s?(\S+)(?:。|$)",
    r"ANSWER\s*:\s*([@])",
    r"[Tt]he answer is:?\s+\(?([@])\)?",
    r"[Tt]he answer is:?\s+\(?\*?\*?([@])\*?\*?\)?",
    r"[Tt]he answer is option:?\s+\(?([@])\)?",
    r"[Tt]he correct answer is:?\s+\(?([@])\)?",
    r"[Tt]he correct answer is option:?\s+\(?([@])\)?",
    r"[Tt]he correct answer is:?.*?boxed\{([@])\}",
    r"[Tt]he correct option is:?.*?boxed\{([@])\}",
    r"[Tt]he correct answer option is:?.*?boxed\{([@])\}",
    r"[Tt]he answer to the question is:?\s+\(?([@])\)?",
    r"^选项\s?([@])",
    r"^([@])\s?选?项",
    r"(\s|^)[@][\s。，,：:\.$]",
    r"1.\s?(.*?)$",
    r"1.\s?([@])[.。$]?$",
    r"答案:\s*([@])",
    r"故此为\s*([@])",
    r"boxed\{([@])\}",
    r"([@]):",
    r"([@])",
)


def first_option(text: Column, options: str = "ABCD", default: str | None = None) -> Column:
    """The option that the first pattern with an option in its first group, or else its match, names."""
    letters = F.array(*map(F.lit, options))

    def named(t: Column, pattern: str) -> Column:
        p = "(?isU)" + pattern.replace("@", options)
        found = F.coalesce(nz(F.regexp_extract(t, p, 1)), F.regexp_extract(t, p, 0))
        return let(found, lambda x: F.get(F.filter(letters, lambda o: F.contains(F.upper(x), F.upper(o))), F.lit(0)))

    return let(strip(text), lambda t: F.coalesce(*[named(t, p) for p in OPTION_PATTERNS], F.lit(default)))


def asr_extract(text: Column, lang: str = "en") -> Column:
    """`<|…|>` marks dropped, white space squeezed (for Chinese removed), no blank before punctuation."""
    bare = squeeze(F.regexp_replace(text, "<\\|[^|]*\\|>", " "))
    return F.regexp_replace(bare, "\\s+", "") if lang == "zh" else F.regexp_replace(bare, "\\s+([,.!?;:])", "$1")


def tool_calls(text: Column) -> Column:
    """The JSON texts inside `<tool_call>` tags, in order."""
    return F.regexp_extract_all(text, F.lit("(?s)<tool_call>\\s*(.*?)\\s*</tool_call>"), 1)
