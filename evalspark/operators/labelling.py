"""Labelling: field mappings and rules compiled to one projection, gaps, buckets, routes, samples, profiles."""

from __future__ import annotations

import re
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.ordering import exact_sample

_RULE = re.compile(r"(\w+)\s*(>=|<=|==|>|<)\s*(\d+)")


def mapped(rows: DataFrame, mapping: dict[str, str | dict], defaults: dict[str, object]) -> DataFrame:
    """One projection of target <- source fields (a name, or {from, prefix}); targets that no rule names have their
    default, and `native` lists the input, reference and condition fields that were mapped."""
    out = {}
    for target, rule in mapping.items():
        source, prefix = (rule, "") if isinstance(rule, str) else (rule["from"], rule.get("prefix", ""))
        value = F.col(source).cast("string")
        out[target] = F.concat(F.lit(prefix), value) if prefix else value
    out |= {t: F.lit(v) for t, v in defaults.items() if t not in out}
    native = [t for t in mapping if t.startswith(("input.", "reference.", "condition."))]
    return rows.select(*[c.alias(t) for t, c in out.items()], F.array(*map(F.lit, sorted(native))).cast("array<string>").alias("native"))


def condition(expression: str) -> Column:
    """`<field> <op> <whole number>` as a Column; what is not of that form is never true, nor is a missing field."""
    m = _RULE.match(expression.strip())
    if not m:
        return F.lit(False)
    c, n = F.col(m[1]), int(m[3])
    return F.coalesce({">": c > n, ">=": c >= n, "==": c == n, "<": c < n, "<=": c <= n}[m[2]], F.lit(False))


def with_rules(rows: DataFrame, rules: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """rows with the fields that rules (condition, values) set; of several, the last that holds counts."""
    fields = list(dict.fromkeys(f for _, values in rules for f in values))
    out = {}
    for f in fields:
        value = F.col(f) if f in rows.columns else F.lit(None).cast("string")
        for when, values in rules:
            if f in values:
                value = F.when(condition(when), F.lit(values[f])).otherwise(value)
        out[f] = value
    return rows.withColumns(out)


def subset_policy(rows: DataFrame, policy: dict[str, dict[str, str]], long_from: float, subset: str = "subset", seconds: str = "duration_sec") -> DataFrame:
    """rows with what the policy of their subset says, and capability long_form_asr from a duration of long_from on."""
    out = {}
    for f in dict.fromkeys(f for values in policy.values() for f in values):
        value = F.col(f)
        for name, values in policy.items():
            if f in values:
                value = F.when(F.col(subset) == name, F.lit(values[f])).otherwise(value)
        out[f] = value
    base = out.get("capability", F.col("capability"))
    out["capability"] = F.when(F.coalesce(F.col(seconds) >= long_from, F.lit(False)) & F.lit(long_from > 0), "long_form_asr").otherwise(base)
    return rows.withColumns(out)


def expanded(rows: DataFrame, expansions: list[dict[str, str]]) -> DataFrame:
    """Every row once per expansion, with its fields."""
    names = sorted({n for e in expansions for n in e})
    each = F.explode(F.array(*[F.struct(*[F.lit(e.get(n)).cast("string").alias(n) for n in names]) for e in expansions]))
    return rows.withColumn("_e", each).select(*[c for c in rows.columns if c not in names], "_e.*")


def gaps(rows: DataFrame, sample_id: str, required: dict[str, list[str]], conditions: dict[str, list[str]]) -> DataFrame:
    """(sample_id, label_field, priority): one row per missing label. Fields are columns of these names; required and
    conditions list them per capability; confidence, reviewed, llm_fields, verified and gate tell about the labels."""
    missing = lambda c: F.coalesce(F.col(f"`{c}`").cast("string") == "", F.lit(True))
    gap = lambda when, field, priority: F.when(when, F.struct(F.lit(field).alias("label_field"), F.lit(priority).alias("priority")))
    of = lambda table, p: [gap((F.col("capability") == c) & missing(f), f, p) for c, fields in table.items() for f in fields]
    low = F.coalesce(F.col("confidence"), F.lit(1.0)) < 0.7
    verified = F.coalesce(F.col("verified"), F.lit(False))
    found = F.array(
        *of(required, "P0"),
        *of(conditions, "P1"),
        gap(missing("audio_path"), "input.audio_path", "P0"),
        gap(low, "label_meta.confidence", "P1"),
        gap((F.col("llm_fields") > 0) & ~F.coalesce(F.col("reviewed"), F.lit(False)), "label_meta.reviewed", "P0"),
        gap(~verified, "label_meta.knowledge_verify_done", "P0"),
        gap(verified & (F.col("gate") == "blocked"), "label_meta.knowledge_gate", "P0"),
        gap(verified & (F.col("gate") == "needs_review"), "label_meta.knowledge_gate", "P1"),
    )
    return rows.select(F.col(sample_id), F.inline(F.array_compact(found)))


def bucket(p0_gaps: Column, any_gaps: Column, required_missing: Column) -> Column:
    """The use bucket of a labelled sample, by columns gate, verified, flagged, confidence, reviewed, sources (an array),
    acoustic, capability_source and preset: the first rule of the ladder that holds."""
    c = F.col
    has = lambda *names: F.arrays_overlap(c("sources"), F.array(*map(F.lit, names)))
    reviewed, gate = F.coalesce(c("reviewed"), F.lit(True)), F.coalesce(c("gate"), F.lit(""))
    passed = gate.isin("pass", "pass_with_revise")
    unsure = (has("llm_draft") & ~reviewed) | has("knowledge_flagged") | (F.coalesce(c("confidence"), F.lit(1.0)) < 0.7)
    inferred = has("rule", "acoustic_model") & ~has("knowledge_verified", "knowledge_revise", "native", "human")
    source = F.coalesce(c("capability_source"), F.lit("rule"))
    ladder = (
        (~F.coalesce(c("verified"), F.lit(False)), F.lit("diagnostic_evidence")),
        (gate == "blocked", F.lit("coverage_debt")),
        ((gate == "needs_review") | F.coalesce(c("flagged"), F.lit(False)), F.lit("diagnostic_evidence")),
        (p0_gaps, F.lit("coverage_debt")),
        (c("acoustic").isin("traffic_noise", "wind_noise") & has("rule", "acoustic_model"), F.lit("stress_test")),
        (unsure, F.lit("diagnostic_evidence")),
        (inferred & any_gaps, F.lit("diagnostic_evidence")),
        (source.isin("rule", "llm_draft", "knowledge_flagged") & ~passed & ~reviewed, F.lit("diagnostic_evidence")),
        (required_missing, F.lit("coverage_debt")),
        (passed & c("preset").isin("diagnostic_evidence", "coverage_debt", "stress_test"), c("preset")),
        (passed | reviewed, F.lit("formal_subscores")),
    )
    out = F.lit("diagnostic_evidence")
    for when, value in reversed(ladder):
        out = F.when(F.coalesce(when, F.lit(False)), value).otherwise(out)
    return out


def route_keys(task: Column, capability: Column, answer_type: Column, language: Column) -> Column:
    """The keys under which an evaluator is looked up, most special first, without repeats."""
    key = lambda *parts: F.concat_ws(":", *[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts])
    t, c, a, g = task, capability, answer_type, language
    every = F.array(key(t, c, a, g), key(t, c, a), key(t, c, g), key(t, c), key(t, g), key(c, a, g), key(c, a), key(c, g), key(c), key(t))
    return F.array_distinct(F.filter(every, lambda k: k != ""))


def routed(rows: DataFrame, keys: Column, routes: DataFrame, default: str) -> DataFrame:
    """rows with the route of the first of their keys that routes (key, route; a closed table) has, else the default."""
    tagged = rows.withColumn("_keys", keys)
    # routes are configuration: some dozens of rows, collected as literals
    table = {r["key"]: r["route"] for r in routes.collect()}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    hit = F.get(F.filter(F.transform("_keys", lambda k: known[k]), lambda r: r.isNotNull()), F.lit(0))
    return tagged.withColumn("route", F.coalesce(hit, F.lit(default))).drop("_keys")


def merged_scores(scores: DataFrame) -> DataFrame:
    """(id, metric, value) of scores (id, pos, evaluator, metric, value): a metric that several evaluators give with
    different values keeps the first one's, and the others are called <evaluator>__<metric>."""
    first = F.min(F.struct("pos", "value")).over(Window.partitionBy("id", "metric"))["value"]
    named = F.when(F.col("value").eqNullSafe(first), F.col("metric")).otherwise(F.concat("evaluator", F.lit("__"), "metric"))
    return scores.select("id", named.alias("metric"), "value").distinct()


def share(n: int, rate: float, rounding: str = ROUND_FLOOR) -> int:
    """n * rate as a whole number, at least 1; rate counts as it is written, so no binary fraction shifts a bound."""
    return max(1, int((n * Decimal(str(rate))).to_integral_value(rounding)))


def audit_sample(rows: DataFrame, sample_id: str, rate: float, seed: int = 42, rounding: str = ROUND_FLOOR) -> DataFrame:
    """share(n, rate) of n rows, the same ones in every run, by a hash of the id and the seed. A sampling operator."""
    if rate <= 0:
        return rows.limit(0)
    n = rows.count()
    if rate >= 1 or not n:
        return rows
    return exact_sample(rows, sample_id, share(n, rate, rounding), seed)


def profile(rows: DataFrame, fields: list[str], most: int = 10, by: str | None = None) -> DataFrame:
    """(field, value, n) of the most frequent values of every field, per value of `by` if named."""
    group = [by] if by else []
    each = rows.select(*group, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    n = each.groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group, "field").orderBy(F.desc("n"), "value"))
    return n.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def costs(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, prompt_tokens, completion_tokens, cost): summed tokens at prices per million."""
    sums = usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    price = lambda k: F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[k]))])[F.col("model")]
    return sums.withColumn("cost", (F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1)) / 1e6)


def audio_seconds(explicit: Column, audios: Column, fallback: Column, positive: bool = True) -> Column:
    """Seconds of a sample: what it says, else the sum over its distinct paths of their duration or end - start, else the
    fallback. audios: array of (path, start, end, duration); a path without either leaves the sum open. Only positive
    values say anything; without `positive`, all that are there count as they stand."""
    said = lambda v: F.when(v > 0, v) if positive else v
    one = lambda a: F.coalesce(said(a["duration"]), said(a["end"] - a["start"]))
    paths = F.array_distinct(F.transform(audios, lambda a: a["path"]))
    # of several mentions of a path the last one counts
    per = F.transform(paths, lambda p: one(F.element_at(F.filter(audios, lambda a: a["path"] == p), -1)))
    total = F.when((F.size(per) > 0) & ~F.exists(per, lambda x: x.isNull()), F.aggregate(per, F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(said(explicit), total, said(fallback))


def compact(value: Column) -> Column:
    """An array joined by |, a map as sorted k=v joined by |."""
    return F.array_join(value, "|")


def compact_map(value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
