"""The slice cube: all metrics of score rows over many grouping sets, in long form, and its nested report.

Rows are aggregated once, at the finest combination of keys that occurs; each of those aggregates then goes to every
grouping set of which it has all keys (null, the empty string and empty arrays and maps are missing), as (slice, label).
Percentiles, rates of verification and F1 come from counts per value, score and label, aggregated the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType

from evalspark.operators import metrics, overlap
from evalspark.sources import events as log
from evalspark.sources.manifests import result_files

# The fields that rows are sliced by, and the columns that are no metrics.
CONDITIONS = ["condition__acoustic", "condition__spatial", "condition__speaker", "condition__device", "condition__interaction"]
METADATA = (
    "device_type device_type_subtype recording_setup recording_setup_subtype noise_type noise_type_subtype snr_bucket snr_bucket_subtype speaker_count "
    "speaker_count_bucket overlap_level overlap_level_subtype language language_mix distance distance_subtype motion_state motion_state_subtype "
    "speaker_age_group speaker_role crowd_density weather authorization_state authorization_state_subtype window_state window_state_subtype hvac_state "
    "hvac_state_subtype media_state media_state_subtype scenario_subtype"
).split()
SLICE_FIELDS = ["scenario__primary", "scenario__secondary", *[f"metadata__{m}" for m in METADATA]]
IGNORED = (
    "id extract_fail pred ref classification_pred classification_ref verification_score verification_label audio_duration_seconds latency_ms "
    "first_token_latency_ms first_audio_chunk_latency_ms memory_peak_mb rtf cpu_usage npu_usage power_watts timeout failure der_error_duration "
    "der_reference_duration annotation_confidence"
).split()
IGNORED_PREFIXES = ("sample_count", "metadata__", "scenario__", "condition__", "subset_", "source_", "catalog_")
SPELLED = {"wer": ("wer%", "wer"), "cer": ("cer%", "cer"), "cpcer": ("cpcer%", "cpcer")}
LATENCIES = {"latency_ms": "latency", "first_token_latency_ms": "first_token_latency", "first_audio_chunk_latency_ms": "first_audio_chunk_latency", "memory_peak_mb": "memory_peak"}
GAUGES = {"rtf": "rtf", "cpu_usage": "cpu_usage", "npu_usage": "npu_usage", "power_watts": "power_watts", "timeout": "timeout_rate", "failure": "failure_rate"}
FORMAL = "formal_subscores"


def default_sets() -> list[list[str]]:
    """The 92 grouping sets that a report has unless others are named."""
    single = lambda *names: [[n] for n in names]
    return [
        *single("task", "capability"),
        ["task", "capability"],
        ["task", "capability", "benchmark_id"],
        ["scenario"],
        ["scenario", "task", "capability"],
        ["scenario__primary", "capability"],
        ["scenario__primary", "scenario__secondary", "capability"],
        *single("use_bucket", "split", "dataset_id", "benchmark_id", "language", "subset_manifest_record_id", "mapping_status", "resource_status"),
        ["task", "capability", "language"],
        ["task", "capability", "use_bucket"],
        *single(*CONDITIONS),
        *[["scenario", c, "capability"] for c in CONDITIONS],
        *single(*SLICE_FIELDS),
        *[["scenario__primary", f"metadata__{m}", "capability"] for m in METADATA],
    ]


def detect_metrics(rows: DataFrame) -> list[str]:
    """The metrics that rows ask for in metric_names (parted by |) and have as numbers; if they ask for none, all
    numeric columns that are no support fields."""
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, NumericType)]
    if "metric_names" in rows.columns:
        # a row per distinct name: metrics are a closed vocabulary
        asked = [r[0] for r in rows.select(F.explode(F.split("metric_names", "\\|")).alias("m")).filter("m <> ''").distinct().orderBy("m").collect()]
        found = [c for m in asked for c in SPELLED.get(m, (m,)) if c in numeric]
        if found:
            return list(dict.fromkeys(found))
    return [c for c in numeric if c not in IGNORED and not c.startswith(IGNORED_PREFIXES) and not c.endswith("_valid")]


def _key(rows: DataFrame, name: str) -> Column:
    """A key as text, null where it is missing; nested values as JSON."""
    kind, c = rows.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (ArrayType, MapType)):
        return F.when(F.size(c) > 0, F.to_json(c))
    if isinstance(kind, StructType):
        return F.to_json(c)
    return F.when(c != "", c) if isinstance(kind, StringType) else c.cast("string")


class Cuboid:
    """Rows grouped at the finest combination of keys that occurs; every grouping set rolls up from there.

    `by` are the key columns, as text; `flat` is rows with them, and keyed() gives them to other rows of those columns.
    expand() gives a table that was grouped by them its slices: a row once per slice that it takes part in, as (slice,
    label) instead of the keys.
    """

    def __init__(self, rows: DataFrame, sets: list[list[str]]):
        self.sets = [s for s in sets if set(s) <= set(rows.columns)]
        self.formal = "use_bucket" in rows.columns
        names = sorted({k for s in self.sets for k in s} | ({"use_bucket"} if self.formal else set()))
        self.place = {k: f"_k{n}" for n, k in enumerate(names)}
        self.by = list(self.place.values())
        self.flat = self.keyed(rows)

    def keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: _key(rows, k) for k, c in self.place.items()})

    def expand(self, grouped: DataFrame) -> DataFrame:
        entry = lambda name, label: F.struct(F.lit(name).alias("slice"), label.alias("label"))

        def one(keys: list[str]) -> Column:
            columns = [F.col(self.place[k]) for k in keys]
            return F.when(~F.greatest(*[c.isNull() for c in columns], F.lit(False)), entry("+".join(keys), F.concat_ws("|", *columns)))

        every = [entry("overall", F.lit(""))]
        if self.formal:
            every.append(F.when(F.col(self.place["use_bucket"]) == FORMAL, entry("formal/overall", F.lit(""))))
        kept = [c for c in grouped.columns if c not in self.by]
        return grouped.select(*kept, F.inline(F.array_compact(F.array(*every, *map(one, self.sets)))))

    def counts(self, rows: DataFrame, *columns: str) -> DataFrame:
        """(keys, columns, m) of keyed rows."""
        return rows.groupBy(*self.by, *columns).agg(F.count(F.lit(1)).alias("m"))

    def rolled(self, counts: DataFrame) -> DataFrame:
        """(slice, label, columns, m) of such counts."""
        slices = self.expand(counts)
        return slices.groupBy(*[c for c in slices.columns if c != "m"]).agg(F.sum("m").alias("m"))


class Merged:
    """Aggregates in two steps: partial ones by cuboid, named here, and what merges them by slice."""

    def __init__(self) -> None:
        self.partial: dict[str, Column] = {}
        self.merges: dict[str, Column] = {}

    def _keep(self, partial: Column, merge: Callable[[str], Column]) -> Column:
        name = f"_p{len(self.partial)}"
        self.partial[name], self.merges[name] = partial, merge(name)
        return merge(name)

    def total(self, c: Column) -> Column:
        return self._keep(F.sum(c), F.sum)

    def count(self, c: Column) -> Column:
        return self._keep(F.count(c), F.sum)

    def mean(self, c: Column) -> Column:
        return F.try_divide(self.total(c.cast("double")), self.count(c))

    def same(self, c: Column) -> Column:
        """Whether all values that are there are one."""
        return F.coalesce(self._keep(F.min(c), F.min) == self._keep(F.max(c), F.max), F.lit(False))


def _long(out: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(slice, label, metric, value) of the values that are not null."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()])
    return out.select("slice", "label", F.inline(each)).filter("value is not null")


#: Overlap scores from summed counts: (metric, prefix of the columns, the score of their sums).
OVERLAPS = (("bleu", overlap.bleu), ("chrf", overlap.chrf))


class Mesh:
    """All metrics of score rows of one schema over grouping sets, in two steps: statistics(rows) are small tables at the
    finest key combination, and cells(tables) are the slices' metrics. Tables of several batches of rows, one behind the
    other, are the tables of all their rows."""

    def __init__(self, rows: DataFrame, sets: list[list[str]] | None = None, names: list[str] | None = None, least_size: int = 5):
        self.has, self.least_size = set(rows.columns), least_size
        self.cuboid, self.merged = Cuboid(rows, default_sets() if sets is None else sets), Merged()
        self.aggs = self._aggregates(rows, detect_metrics(rows) if names is None else names)
        self.latencies = [c for c in LATENCIES if c in self.has]
        self.failures = [c for c in ("failure_stage", "failure_type") if c in self.has]

    def _aggregates(self, rows: DataFrame, names: list[str]) -> dict[str, Column]:
        merged, has, c = self.merged, self.has, lambda n: F.col(f"`{n}`")
        aggs = {"sample_count": merged.count(F.lit(1))}
        for m in names:
            aggs |= {m: merged.mean(c(m)), f"{m}/sample_count": F.nullif(merged.count(c(m)), F.lit(0))}
        for m, usual in (("wer", "en"), ("cer", "zh")):
            if {f"{m}_errors", f"{m}_n"} <= has:
                language = F.coalesce(F.nullif(F.lower("language"), F.lit("")), F.lit(usual)) if "language" in has else F.lit(usual)
                alone = merged.same(F.when(c(f"{m}_n").isNotNull(), language))
                aggs |= {f"{m}%": F.when(alone, F.try_divide(100.0 * merged.total(c(f"{m}_errors")), merged.total(c(f"{m}_n")))), f"{m}%/sample_count": F.when(alone, merged.count(c(f"{m}_n")))}
        for m, score in OVERLAPS:
            if f"{m}_counts" in has:
                counts = c(f"{m}_counts")
                n = F.nullif(merged.count(counts), F.lit(0))
                value = score({f: merged.total(counts[f]) for f in rows.schema[f"{m}_counts"].dataType.fieldNames()})
                tokens = f"{m}_tokenizer"
                fits = merged.same(F.when(counts.isNotNull(), c(tokens))) if tokens in has else n > 0
                aggs |= {m: F.when(fits, value), f"{m}/sample_count": F.when(fits, n)}
        if {"der", "der_error_duration", "der_reference_duration"} <= has:
            enough = c("der").isNotNull() & c("der_error_duration").isNotNull() & (c("der_reference_duration") > 0)
            ready = merged.count(F.when(enough, 1))
            complete = ready == merged.count(c("der"))
            weighed = F.try_divide(merged.total(F.when(enough, c("der_error_duration"))), merged.total(F.when(enough, c("der_reference_duration"))))
            spoken = F.when(complete, merged.total(F.when(enough, c("der_reference_duration"))))
            aggs |= {"der": F.when(complete, weighed).otherwise(merged.mean(c("der"))), "der/sufficient_statistics_count": F.when(~complete, ready), "der/reference_duration_seconds": spoken, "der/sample_count": F.when(complete, F.nullif(ready, F.lit(0))).otherwise(aggs.get("der/sample_count", F.lit(None)))}
        if "annotation_confidence" in has:
            aggs |= {"confidence_mean": merged.mean(c("annotation_confidence"))}
        for column, name in GAUGES.items():
            if column in has:
                aggs |= {name: merged.mean(c(column)), f"{name}/sample_count": F.nullif(merged.count(c(column)), F.lit(0))}
        return aggs

    def statistics(self, rows: DataFrame) -> dict[str, DataFrame]:
        cuboid, flat = self.cuboid, self.cuboid.keyed(rows)
        out = {"sums": flat.groupBy(*cuboid.by).agg(*[v.alias(k) for k, v in self.merged.partial.items()])}
        out |= {c: metrics.histogram(flat, cuboid.by, c) for c in self.latencies}
        if {"classification_pred", "classification_ref"} <= self.has:
            out["classification"] = cuboid.counts(flat.filter("classification_pred <> '' and classification_ref <> ''"), "classification_pred", "classification_ref")
        if {"verification_score", "verification_label"} <= self.has:
            out["verification"] = cuboid.counts(flat.filter("verification_score is not null"), "verification_score", "verification_label")
        return out | {c: cuboid.counts(flat.filter(F.col(c) != ""), c) for c in self.failures}

    def cells(self, tables: dict[str, DataFrame]) -> DataFrame:
        """(slice, label, metric, value)."""
        keys, cuboid = ["slice", "label"], self.cuboid
        wide = cuboid.expand(tables["sums"]).groupBy(*keys).agg(*[v.alias(f"a{k}") for k, v in enumerate(self.aggs.values())])
        out = _long(wide, {m: F.col(f"a{k}") for k, m in enumerate(self.aggs)} | {"small_sample": F.when(F.col("a0") < self.least_size, 1)})
        for column in self.latencies:
            name = LATENCIES[column]
            p = metrics.percentiles(tables[column], keys, name, expand=cuboid.expand)
            out = out.unionByName(_long(p, {f"{name}_p{q}": F.col(f"{name}_p{q}") for q in (50, 90, 95)}))
        if "classification" in tables:
            f1 = metrics.macro_f1(cuboid.rolled(tables["classification"]), "classification_pred", "classification_ref", keys, "m")
            out = out.unionByName(_long(f1, {"macro_f1": F.col("macro_f1")}))
        if "verification" in tables:
            both = metrics.verification(cuboid.rolled(tables["verification"]), "verification_score", "verification_label", keys, "m")
            # a slice of one class has neither
            out = out.unionByName(_long(both.filter("auc is not null"), {"auc": F.col("auc"), "eer": F.col("eer")}))
        for column in self.failures:
            n = cuboid.rolled(tables[column])
            out = out.unionByName(n.select(*keys, F.concat(F.lit(f"{column}/"), F.col(column), F.lit("/count")).alias("metric"), F.col("m").cast("double").alias("value")))
        return out


def mesh(rows: DataFrame, sets: list[list[str]] | None = None, names: list[str] | None = None, least_size: int = 5) -> DataFrame:
    """(slice, label, metric, value) of every slice: sample_count, small_sample (1 below least_size), and of each metric
    its mean and <metric>/sample_count.

    Over means stand: error rates `wer%` and `cer%` where rows have <wer|cer>_errors and <wer|cer>_n (summed; gone where a
    slice mixes languages, of which a missing one is en for words and zh for characters), `bleu` and `chrf` of summed
    counts where rows have them as a struct <metric>_counts (gone where a slice mixes <metric>_tokenizer, if there is
    such a column), `der` by duration where all its rows have durations, macro_f1 of classification_pred and _ref, eer
    and auc of verification_score and _label, percentiles of latencies, means of gauges and rates,
    annotation_confidence as confidence_mean, and counts of failure_stage and failure_type.

    Rows are aggregated once at the finest key combination; only those aggregates meet the grouping sets.
    """
    plan = Mesh(rows, sets, names, least_size)
    return plan.cells(plan.statistics(rows))


def coverage(rows: DataFrame, fields: list[str], sources: dict[str, str] | None = None) -> DataFrame:
    """(field, metric, value) per field: known_count, missing_or_unknown_count, known_rate, and, where a column names the
    source of the field, source/<name>/count of the known rows."""
    known = lambda f: F.coalesce(_key(rows, f) != "unknown", F.lit(False))
    each = F.array(*[F.struct(F.lit(f).alias("field"), known(f).alias("known"), (F.coalesce(F.col((sources or {})[f]), F.lit("unknown")) if f in (sources or {}) else F.lit(None).cast("string")).alias("source")) for f in fields])
    flat = rows.select(F.inline(each))
    n = F.count(F.lit(1))
    per = flat.groupBy("field").agg(F.count(F.when(F.col("known"), 1)).alias("k"), n.alias("n"))
    values = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in (("known_count", F.col("k")), ("missing_or_unknown_count", F.col("n") - F.col("k")), ("known_rate", F.col("k") / F.col("n")))])
    by = flat.filter("known and source is not null").groupBy("field", F.concat(F.lit("source/"), "source", F.lit("/count")).alias("metric")).agg(n.cast("double").alias("value"))
    return per.select("field", F.inline(values)).unionByName(by)


def nested_report(cells: DataFrame) -> DataFrame:
    """(path, metric, value) of the report tree: overall, formal/overall, by_capability/<c> and
    by_scenario/<s>/by_capability/<c>; metrics have __ for /."""
    scenario, capability = F.split_part("label", F.lit("|"), F.lit(1)), F.split_part("label", F.lit("|"), F.lit(2))
    path = (
        F.when(F.col("slice").isin("overall", "formal/overall"), F.col("slice"))
        .when(F.col("slice") == "capability", F.concat(F.lit("by_capability/"), "label"))
        .when(F.col("slice") == "scenario__primary+capability", F.concat(F.lit("by_scenario/"), scenario, F.lit("/by_capability/"), capability))
    )
    return cells.select(path.alias("path"), F.replace("metric", F.lit("/"), F.lit("__")).alias("metric"), "value").filter("path is not null")


def report_json(report: DataFrame) -> dict:
    """The tree of a report, which is small, as nested dicts on the driver."""
    out: dict = {}
    for path, metric, value in report.orderBy("path", "metric").collect():
        at = out
        for part in path.split("/"):
            at = at.setdefault(part, {})
        at[metric] = value
    return out


def summary_errors(report: dict, expected: int, required: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a report's overall part: its size, missing metrics, failures."""
    overall = report.get("overall", {})
    errors = [] if overall.get("sample_count") == expected else [f"sample_count is {overall.get('sample_count')}, not {expected}"]
    errors += [f"missing {k}" for k in required if k not in overall]
    return errors + ([f"failure_rate is {overall['failure_rate']}"] if overall.get("failure_rate") else [])


def difference(before: DataFrame, after: DataFrame, least: float = 0.0) -> DataFrame:
    """(slice, label, metric, before, after, delta) of the cells that two cubes don't share, or share with values that
    differ by more than `least`; a cell that one cube lacks is null there."""
    keys = ["slice", "label", "metric"]
    both = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), keys, "full")
    delta = F.col("after") - F.col("before")
    return both.select(*keys, "before", "after", delta.alias("delta")).filter(delta.isNull() | (F.abs(delta) > least))


def suite_report(spark: SparkSession, folder: str, schema: str, sets: list[list[str]] | None = None, excluded: tuple[str, ...] = (), glob: str = "*.jsonl") -> DataFrame:
    """(path, metric, value) of all runs below a folder, as one job: their event logs are found, the rows that
    count are taken (eval and error events outside the excluded capabilities), cut into cells, and put in a tree.

    schema: the fields of an event's data that score rows have."""
    lines = result_files(spark, folder, glob).select(F.from_json("value", f"type string, id string, data struct<{schema}>").alias("e"))
    rows = log.score_rows(lines.select("e.type", "e.id", "e.data.*"), excluded)
    return nested_report(mesh(rows.drop("type", "id"), sets))
