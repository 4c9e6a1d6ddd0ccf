"""Structured answers: the leaves of nested JSON as `path=value` items, and scores over items."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from evalspark.functions import text_udf as U
from evalspark.functions.text import let

_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
_TAG = re.compile(r"<tool_call>\s*([\s\S]*?)\s*</tool_call>", re.IGNORECASE)
#: Fields that name a tool or an intent, and fields that hold its arguments (fixed values).
NAME_FIELDS = ("tool", "name", "action", "type", "function", "intent")
ARGUMENT_FIELDS = ("arguments", "parameters", "slots")


def scalar(value) -> str:
    """A leaf in canonical form."""
    if isinstance(value, bool):
        return str(value).lower()
    if value is None:
        return ""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return " ".join(unicodedata.normalize("NFKC", str(value)).lower().split())


def parsed(text: str | None):
    """The JSON inside a text: a fenced block, the whole, the outermost braces or brackets; None without any."""
    fenced = _FENCE.search(text or "")
    inner = (fenced[1] if fenced else text or "").strip()
    spans = [inner] + [inner[inner.find(a) : inner.rfind(b) + 1] for a, b in ("{}", "[]") if 0 <= inner.find(a) < inner.rfind(b)]
    for span in spans:
        try:
            return json.loads(span)
        except ValueError:
            continue
    return None


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, leaf) of nested values: a.b[0]; a bare scalar has the path $."""
    if isinstance(value, dict):
        for key, item in value.items():
            yield from leaves(item, f"{path}.{key}" if path else str(key))
    elif isinstance(value, list):
        for k, item in enumerate(value):
            yield from leaves(item, f"{path}[{k}]")
    else:
        yield path or "$", value


def items(value) -> list[str]:
    return sorted(f"{path}={scalar(leaf)}" for path, leaf in leaves(value))


def _present(*values):
    return next((v for v in values if v is not None and v != "" and v != []), None)


def _call(value: dict) -> tuple[str, object]:
    """Name and arguments of one call; without a field for arguments, all other fields are."""
    name = _present(*(value.get(f) for f in NAME_FIELDS))
    inner = value.get("function") if isinstance(value.get("function"), dict) else {}
    if isinstance(name, dict):
        name = _present(name.get("name"), name.get("tool"))
    given = _present(*(value.get(f) for f in ARGUMENT_FIELDS), inner.get("arguments"))
    return scalar(name), {k: v for k, v in value.items() if k not in NAME_FIELDS} if given is None else given


def calls(text: str | None) -> tuple[list[str], list[str]] | None:
    """Names in order and items of the arguments of the calls in a text; None without JSON."""
    tagged = _TAG.findall(text or "")
    found = [parsed(t) for t in tagged] if tagged else parsed(text)
    if found is None or (tagged and None in found):
        return None
    if tagged and len(found) == 1:
        found = found[0]
    if isinstance(found, dict):
        found = found["tool_calls"] if isinstance(found.get("tool_calls"), list) else [found]
    each = [_call(c) for c in found if isinstance(c, dict)] if isinstance(found, list) else []
    return [name for name, _ in each], items([arguments for _, arguments in each])


_STRINGS = ArrayType(StringType())


@F.arrow_udf(returnType=_STRINGS)
def leaf_items(text: pa.Array) -> pa.Array:
    """Sorted items of a JSON text, null without JSON."""
    out = []
    for t in text.to_pylist():
        value = parsed(t)
        out.append(None if value is None else items(value))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(returnType=_STRINGS)
def slot_items(text: pa.Array) -> pa.Array:
    """Items of the slots, arguments or parameters of a JSON text, or of the text itself; none without JSON."""
    out = []
    for t in text.to_pylist():
        value = parsed(t)
        if isinstance(value, dict):
            value = _present(*(value.get(f) for f in ("slots", "arguments", "parameters")), value)
        out.append(items({} if value is None else value))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(returnType=_STRINGS)
def labels_of(text: pa.Array) -> pa.Array:
    """Labels of a text: a JSON list; the keys that a JSON object sets (or those of its events, attributes, labels,
    entities or slots); else what commas part. Each in canonical form."""

    def named(t: str | None) -> list[str]:
        value = parsed(t)
        if isinstance(value, dict):
            value = _present(*(value.get(f) for f in ("events", "attributes", "labels", "entities", "slots")), value)
        if isinstance(value, dict):
            return [k for k, on in value.items() if on]
        return value if isinstance(value, list) else [p for p in map(str.strip, (t or "").split(",")) if p]

    return pa.array([[scalar(x) for x in named(t)] for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(returnType=StructType([StructField("names", _STRINGS), StructField("arguments", _STRINGS)]))
def tool_items(text: pa.Array) -> pa.Array:
    """Names and argument items of the tool calls in a text, null without JSON."""
    kind = pa.struct([("names", pa.list_(pa.string())), ("arguments", pa.list_(pa.string()))])
    found = [calls(t) for t in text.to_pylist()]
    return pa.array([None if c is None else {"names": c[0], "arguments": c[1]} for c in found], kind)


def item_scores(predicted: Column, reference: Column) -> Column:
    """precision, recall and f1 of two arrays of items as multisets; both empty: 1, 1, 1."""
    p, r = F.coalesce(predicted, F.array().cast("array<string>")), F.coalesce(reference, F.array().cast("array<string>"))
    share = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    def scored(s: Column) -> Column:
        both = (s["np"] == 0) & (s["nr"] == 0)
        one = lambda c: F.when(both, 1.0).otherwise(c)
        return F.struct(one(share(s["n"], s["np"])).alias("precision"), one(share(s["n"], s["nr"])).alias("recall"), one(share(2 * s["n"], s["np"] + s["nr"])).alias("f1"))

    return let(F.struct(U.common_count(p, r).alias("n"), F.size(p).alias("np"), F.size(r).alias("nr")), scored)


def json_scores(predicted: Column, reference: Column) -> dict[str, Column]:
    """json_valid, exact and item scores of structured answers; an answer that is no JSON scores 0."""
    p, r = leaf_items(predicted), leaf_items(reference)
    s = item_scores(p, r)
    zero = lambda c: F.when(p.isNotNull(), c).otherwise(0.0)
    return {"json_valid": p.isNotNull().cast("int"), "exact": F.coalesce(p == r, F.lit(False)).cast("int")} | {c: zero(s[c]) for c in ("precision", "recall", "f1")}


def tool_scores(predicted: Column, reference: Column) -> dict[str, Column]:
    """json_valid, tool_acc (names in order), parameter_acc, parameter_f1 and task_success of tool calls."""
    p, r = tool_items(predicted), tool_items(reference)
    valid = p.isNotNull() & r.isNotNull()
    tool = valid & (F.size(r["names"]) > 0) & (p["names"] == r["names"])
    same = valid & (p["arguments"] == r["arguments"])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    f1 = F.when(valid, item_scores(p["arguments"], r["arguments"])["f1"]).otherwise(0.0)
    return {"json_valid": flag(valid), "tool_acc": flag(tool), "parameter_acc": flag(same), "parameter_f1": f1, "task_success": flag(tool & same)}
