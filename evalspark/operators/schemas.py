"""Manifest records of any shape to columns of one schema, compiled from a table of fields and a taxonomy.

A schema is data: each field has the paths that it may come from, what cleans it, and an alias table; a taxonomy is data
too (closed vocabularies, a few thousand terms at most, kept as literals). Both become one projection over a VARIANT
column: every field's value and the path that it came from, and an array of what is wrong with the record.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import let
from evalspark.operators.ordering import lines

Taxonomy = Mapping[str, object]


def at(record: Column, path: str) -> Column:
    """What a path of a VARIANT holds, as text: truth values as True and False, lists and objects as JSON; null where it
    is missing, null, empty text, or an empty list."""
    value = F.try_variant_get(record, path, "variant")
    text = F.try_variant_get(record, path, "string")
    shown = F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)
    return F.when(~shown.isin("", "[]"), shown)


def held_values(record: Column, paths: Sequence[str]) -> Column:
    """What held_readers read: an array of the paths' types (VOID if missing) and of what `at` gives."""

    def one(value: Column) -> Column:
        kind, text = F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.try_variant_get(value, "$", "string")
        shown = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
        return F.struct(kind.alias("kind"), F.when(~shown.isin("", "[]"), shown).alias("text"))

    return let(record, lambda r: F.transform(F.array(*[F.try_variant_get(r, p, "variant") for p in paths]), one))


def held_readers(held: Column, paths: Sequence[str]) -> list[Callable[[str], Column]]:
    """Two functions from a path to a Column of held_values: its text and its type."""
    return [lambda p, n=n: F.get(held, F.lit(paths.index(p)))[n] for n in ("text", "kind")]


def opened(record: Column, paths: Sequence[str], body: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> Column:
    """body(text, kind) of held_readers: every path is read once per row, however often body names it."""
    paths = list(dict.fromkeys(paths))
    return let(held_values(record, paths), lambda held: body(*held_readers(held, paths)))


def as_list(record: Column, path: str) -> Column:
    """A path's list of texts; a single value is a list of one, a missing one is empty."""
    many = F.try_variant_get(record, path, "array<string>")
    one = F.when(~F.schema_of_variant(F.try_variant_get(record, path, "variant")).startswith("ARRAY"), at(record, path))
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def unprefixed(text: Column) -> Column:
    """Text without what stands before its first colon."""
    return F.regexp_replace(F.trim(text), "(?s)^[^:]*:", "")


def looked_up(text: Column, table: Mapping[str, str]) -> Column:
    """A text's alias, or itself."""
    pairs = [F.lit(x) for kv in (table or {}).items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[text], text) if pairs else text


@dataclass(frozen=True)
class Field:
    """A column: the paths it may come from (the first that holds anything counts), the default, and what cleans it."""

    name: str
    paths: Sequence[str]
    default: str | None = None
    clean: Callable[[Column], Column] = lambda c: c
    aliases: str | None = None

    def value(self, record: Column, taxonomy: Taxonomy) -> tuple[Column, Column]:
        """(value, origin): origin is the path, or `default`."""
        found = [F.struct(at(record, p).alias("value"), F.lit(p).alias("origin")) for p in self.paths]
        if self.default is not None:
            found.append(F.struct(F.lit(self.default).alias("value"), F.lit("default").alias("origin")))
        first = F.get(F.filter(F.array(*found), lambda s: s["value"].isNotNull()), F.lit(0))
        value = self.clean(first["value"])
        return (looked_up(value, taxonomy.get(self.aliases)) if self.aliases else value), first["origin"]


def any_of(record: Column, *paths: str) -> Column:
    """Whether any of the paths holds something."""
    return F.coalesce(*[at(record, p) for p in paths]).isNotNull()


CONDITIONS = ("acoustic", "spatial", "speaker", "device", "interaction")
_STRUCTURED = ("$.reference.json", "$.reference.expected_output", "$.reference.segments", "$.reference.utterances", "$.target.reference_json")
_AUDIO = ("$.reference.audio_uri", "$.target.reference_audio_uri")
_LABELS = tuple(f"$.reference.{k}" for k in ("label", "answer", "intent", "same_speaker", "should_execute"))
_TURNS = ("$.reference.turns", "$.target.turns")
_TEXTS = (*(f"$.reference.{k}" for k in ("text", "answer", "label", "caption", "summary", "transcript", "same_speaker", "should_execute")), "$.target.reference_text", "$.target.answer",
          "$.reference.acceptable_answers[0]", "$.reference.acceptable_answers", "$.target.acceptable_answers[0]", "$.target.acceptable_answers")
_tag = lambda name, tag: (f"$.{name}", f"$.tags.{tag}[0]", f"$.tags.{tag}")

#: Where records of the first schema keep what (paths and names are fixed values).
RECORD_FIELDS = (
    Field("dataset_id", ("$.dataset_id", "$.dataset", "$.source.benchmark_id")),
    Field("task", _tag("task", "task_tags"), clean=unprefixed),
    Field("capability", _tag("capability", "capability_tags"), clean=unprefixed),
    Field("scenario", _tag("scenario", "scenario_tags"), clean=unprefixed),
    Field("language", ("$.language", "$.metadata.language", "$.lang"), ""),
    Field("use_bucket", ("$.use_bucket",), "diagnostic_evidence"),
    Field("split", ("$.split", "$.source.original_split"), "", clean=lambda c: F.trim(F.lower(unprefixed(c))), aliases="split_aliases"),
    Field("audio", ("$.WavPath", "$.WavPath1", "$.input.audio_path", "$.input.audios[0].uri"), ""),
    Field("audio_b", ("$.WavPath2", "$.input.audio_path_b", "$.input.audios[1].uri"), ""),
    Field("reference_text", _TEXTS, ""),
    Field("sample_id", ("$.sample_id", "$.source.original_id")),
)


def _metrics(record: Column, capability: Column, taxonomy: Taxonomy) -> Column:
    listed = F.when(F.size(as_list(record, "$.metrics")) > 0, as_list(record, "$.metrics")).otherwise(as_list(record, "$.metadata.metrics"))
    named = lambda parts: F.array_distinct(F.filter(F.transform(parts, lambda p: looked_up(F.lower(unprefixed(p)), taxonomy.get("metric_aliases"))), lambda n: n != ""))
    own = named(F.filter(F.flatten(F.transform(listed, lambda m: F.split(m, "[,|]"))), lambda p: F.trim(p) != ""))
    defaults = taxonomy.get("default_metrics") or {}
    entries = [x for k, v in defaults.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    usual = named(F.create_map(*entries)[capability]) if entries else F.array().cast("array<string>")
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(usual, F.array().cast("array<string>")))


def _conditions(record: Column) -> Column:
    """Conditions as a map of texts, lists joined by |: the record's own, then those of its metadata."""
    compact = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), "|")).otherwise(at(v, "$"))
    own = F.coalesce(F.try_variant_get(record, "$.condition", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    mine = F.map_filter(F.transform_values(own, lambda _, v: compact(v)), lambda _, v: v.isNotNull() & (v != ""))
    group = lambda g: F.struct(F.lit(g).alias("key"), compact(F.try_variant_get(record, f"$.metadata.{g}", "variant")).alias("value"))
    more = F.filter(F.array(*map(group, CONDITIONS)), lambda e: e["value"].isNotNull() & (e["value"] != "") & ~F.map_contains_key(mine, e["key"]))
    return F.map_concat(mine, F.map_from_entries(more))


def normalized(rows: DataFrame, record: str, taxonomy: Taxonomy, default_task: str = "", default_dataset_id: str = "", reference: str = "text") -> DataFrame:
    """rows with the columns of RECORD_FIELDS, metrics, condition (a map), answer_type, source_split and origin (a map from
    field to path) of a VARIANT column. default_task and default_dataset_id stand where a record has none."""
    r = F.col(record)
    values, origins = {}, []
    defaults = {"task": default_task or None, "dataset_id": default_dataset_id or None}
    for f in RECORD_FIELDS:
        f = Field(f.name, f.paths, defaults.get(f.name, f.default), f.clean, f.aliases)
        if f.name == "reference_text":
            f = Field(f.name, (f"$.{reference}", *f.paths), f.default)
        values[f.name], origin = f.value(r, taxonomy)
        origins += [F.lit(f.name), origin]
    kind = (
        F.when(any_of(r, "$.answer_type", "$.target.answer_type"), F.coalesce(at(r, "$.answer_type"), at(r, "$.target.answer_type")))
        .when(any_of(r, *_STRUCTURED), "structured_json").when(any_of(r, *_AUDIO), "audio").when(any_of(r, *_LABELS), "classification").when(any_of(r, *_TURNS), "dialogue").otherwise("text")
    )
    raw_split = F.coalesce(at(r, "$.split"), at(r, "$.source.original_split"))
    source_split = F.when(values["split"] != F.trim(F.lower(unprefixed(raw_split))), F.coalesce(at(r, "$.source_split"), raw_split)).otherwise(at(r, "$.source_split"))
    out = rows.withColumns(values | {"answer_type": kind, "source_split": source_split, "condition": _conditions(r), "origin": F.map_filter(F.create_map(*origins), lambda _, v: v.isNotNull())})
    out = out.withColumn("metrics", _metrics(r, F.col("capability"), taxonomy))
    return out.withColumn("sample_id", F.coalesce("sample_id", F.concat(F.coalesce(F.nullif("dataset_id", F.lit("")), F.lit("sample")), F.lit("-unknown"))))


def _terms(values: object) -> Column:
    return F.array(*[F.lit(str(v)) for v in values or ()]).cast("array<string>")


def _listed(table: object, key: Column, default: object = ()) -> Column:
    """The list that a table has for a key."""
    pairs = [x for k, v in (table or {}).items() for x in (F.lit(k), _terms(v))]
    return F.coalesce(F.create_map(*pairs)[key], _terms(default)) if pairs else _terms(default)


def _wrong(bad: Column, *message: Column | str) -> Column:
    """A list of one error, or of none."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m, F.lit("")) for m in message]))).otherwise(none)


REQUIRED = ("sample_id", "dataset_id", "task", "capability", "scenario", "condition", "answer_type", "split")


def errors(record: str, taxonomy: Taxonomy, reference: str = "text") -> Column:
    """What is wrong with a normalised record, in order: missing fields, unknown terms, terms that don't belong together,
    conditions and references that its capability requires, no reference, no audio."""
    c, r = F.col, F.col(record)
    blank = lambda n: (F.size(c(n)) == 0) if n == "condition" else F.coalesce(c(n), F.lit("")) == ""
    unknown = lambda n, what, terms: _wrong((F.coalesce(c(n), F.lit("")) != "") & ~F.array_contains(_terms(terms), c(n)), f"unknown {what}: ", c(n))
    each = lambda items, bad, text: F.transform(F.filter(items, bad), text)
    own = _listed(taxonomy.get("capabilities"), c("task"))
    allowed = taxonomy.get("conditions") or {}
    entries = F.map_entries("condition")
    groups = each(entries, lambda e: ~F.array_contains(_terms(allowed), e["key"]), lambda e: F.concat(F.lit("unknown condition group: "), e["key"]))
    # an item of a known group that the group doesn't have
    items = F.flatten(F.transform(entries, lambda e: F.transform(F.split(e["value"], "\\|"), lambda v: F.struct(e["key"].alias("group"), v.alias("item")))))
    terms = each(items, lambda x: F.array_contains(_terms(allowed), x["group"]) & ~F.array_contains(_listed(allowed, x["group"]), x["item"]), lambda x: F.concat(F.lit("unknown condition "), x["group"], F.lit(": "), x["item"]))
    required = taxonomy.get("required_conditions") or {}
    wanted = F.when(c("use_bucket") == "formal_subscores", _listed({k: v for k, v in required.items() if k != "default"}, c("capability"), required.get("default"))).otherwise(_terms(()))
    lacking = each(wanted, lambda g: ~F.map_contains_key("condition", g), lambda g: F.concat(F.lit("missing required condition for "), c("capability"), F.lit(": "), g))
    needs = taxonomy.get("required_reference") or {}
    fields = sorted({f for v in needs.values() for f in v})
    there = F.array_compact(F.array(*[F.when(at(r, f"$.reference.{f}").isNotNull(), f) for f in fields], F.lit(None).cast("string")))
    absent = each(_listed(needs, c("capability")), lambda f: ~F.array_contains(there, f), lambda f: F.concat(F.lit("capability "), c("capability"), F.lit(" requires reference."), f))
    other = ("audio", "structured_json", "action", "dialogue")
    return F.concat(
        *[_wrong(blank(n), f"missing required field: {n}") for n in REQUIRED],
        _wrong(F.size("metrics") == 0, "missing required field: metrics"),
        each(c("metrics"), lambda m: ~F.array_contains(_terms(taxonomy.get("metrics")), m), lambda m: F.concat(F.lit("unknown metric: "), m)),
        unknown("task", "task", taxonomy.get("tasks")),
        _wrong((F.coalesce(c("capability"), F.lit("")) != "") & ~F.array_contains(own, c("capability")), "capability ", c("capability"), " does not belong to task ", c("task")),
        unknown("scenario", "scenario", taxonomy.get("scenarios")),
        unknown("split", "split", taxonomy.get("splits")),
        unknown("use_bucket", "use_bucket", taxonomy.get("use_buckets")),
        groups, terms, lacking, absent,
        _wrong((c("reference_text") == "") & ~c("answer_type").isin(*other), f"missing reference column: {reference}"),
        _wrong((c("audio") == "") & (c("audio_b") == ""), "missing audio input"),
    )


#: Fields that records of the second schema must have (fixed values).
V2_REQUIRED = ("schema_version", "sample_id", "dataset", "task", "capability", "capability_protocol", "scenario", "metadata", "input", "reference", "provenance", "use_bucket", "split")


def v2_errors(record: Column, taxonomy: Taxonomy, formal: bool = True) -> Column:
    """What is wrong with a record of the second schema; its protocol is resolved elsewhere. taxonomy: tasks (task to
    capabilities), primary, secondary (primary to secondaries), enums (metadata field to terms), core_fields."""
    paths = [*[f"$.{f}" for f in V2_REQUIRED], "$.scenario.primary", "$.scenario.secondary", "$.metadata.speaker_count", *[f"$.metadata.{n}" for n in taxonomy.get("core_fields") or ()]]
    return let(record, lambda r: opened(r, paths, lambda held, kind: _v2_errors(r, held, kind, taxonomy, formal)))


def _v2_errors(record: Column, at: Callable[[str], Column], kind: Callable[[str], Column], taxonomy: Taxonomy, formal: bool) -> Column:
    text = lambda p: F.coalesce(at(p), F.lit(""))
    task, capability, primary = text("$.task"), text("$.capability"), at("$.scenario.primary")
    tasks, secondary = taxonomy.get("tasks") or {}, at("$.scenario.secondary")
    there = lambda p: at(p).isNotNull() & (at(p) != "{}")
    shaped = lambda p: ~there(p) | kind(p).startswith("OBJECT")
    formal_row = F.lit(formal) & (text("$.use_bucket") == "formal_subscores")
    shown = F.coalesce(primary, F.lit("None"))

    def enum(name: str, terms: object) -> Column:
        return F.transform(F.filter(as_list(record, f"$.metadata.{name}"), lambda v: (v != "") & ~F.array_contains(_terms(terms), v)), lambda v: F.concat(F.lit(f"unknown metadata.{name}: "), v))

    count = "$.metadata.speaker_count"
    whole = kind(count).isin("BIGINT", "INT", "SMALLINT", "TINYINT") & (at(count).try_cast("long") >= 0)
    return F.concat(
        *[_wrong(~there(f"$.{f}"), f"missing required V2 field: {f}") for f in V2_REQUIRED],
        _wrong(text("$.schema_version") != "2.0", "unsupported canonical schema_version: ", F.coalesce(at("$.schema_version"), F.lit("None"))),
        _wrong(~F.array_contains(_terms(tasks), task), "unknown V2 task: ", task),
        _wrong(F.array_contains(_terms(tasks), task) & ~F.array_contains(_listed(tasks, task), capability), "capability ", capability, " does not belong to V2 task ", task),
        _wrong(~shaped("$.scenario"), "V2 scenario must be an object"),
        _wrong(shaped("$.scenario") & ~F.array_contains(_terms(taxonomy.get("primary")), shown), "unknown V2 scenario.primary: ", shown),
        _wrong(shaped("$.scenario") & secondary.isNotNull() & ~F.array_contains(_listed(taxonomy.get("secondary"), shown), secondary), "scenario.secondary ", secondary, " does not belong to ", shown),
        _wrong(~shaped("$.metadata"), "V2 metadata must be an object"),
        *[enum(n, terms) for n, terms in (taxonomy.get("enums") or {}).items()],
        _wrong((kind(count) != "VOID") & ~whole, "metadata.speaker_count must be a non-negative integer or null"),
        *[_wrong(formal_row & (F.coalesce(at(f"$.metadata.{n}"), F.lit("unknown")) == "unknown"), f"formal V2 sample has unknown core metadata: {n}") for n in taxonomy.get("core_fields") or ()],
        _wrong(formal_row & (primary == "unknown"), "formal V2 sample has unknown scenario.primary"),
    )


def expanded(text: Column, environment: Mapping[str, str]) -> Column:
    """Text with ${NAME} and ${NAME:-default} replaced: names of the environment by its values, others by their default;
    a name that is neither stays as it is."""
    for name, value in environment.items():
        safe = value.replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, r"\$\{" + name + r"(:-[^}]*)?\}", safe)
    return F.regexp_replace(text, r"\$\{\w+:-([^}]*)\}", "$1")


def unified_scan(spark: SparkSession, path: str | list[str], taxonomy: Taxonomy, strict: bool = False, environment: Mapping[str, str] | None = None, **defaults: str) -> DataFrame:
    """JSON lines as normalised records: file, line, record (VARIANT), the columns of `normalized`, with audio paths from
    the manifest's folder, and schema_errors (null where there are none). Lines that are no JSON have no record and the
    error `not JSON`; blank lines are left out. strict raises ValueError where any record has errors."""
    rows = lines(spark, path).filter(F.trim("value") != "")
    parsed = rows.select("file", "line", F.try_parse_json(expanded(F.col("value"), environment or {})).alias("record"))
    out = normalized(parsed, "record", taxonomy, **defaults)
    folder = F.regexp_replace("file", "[^/]*$", "")
    local = lambda p: F.when((p == "") | p.startswith("/") | p.rlike(r"^\w+://"), p).otherwise(F.concat(folder, p))
    wrong = F.when(F.col("record").isNull(), F.array(F.lit("not JSON"))).otherwise(errors("record", taxonomy, defaults.get("reference", "text")))
    out = out.withColumn("schema_errors", let(wrong, lambda e: F.when(F.size(e) > 0, e)))
    out = out.withColumns({n: local(F.col(n)) for n in ("audio", "audio_b")})
    if strict and (first := out.filter("schema_errors is not null").select("file", "line", "schema_errors").first()):
        raise ValueError(f"{first.file}:{first.line + 1} failed schema validation: {first.schema_errors}")
    return out
