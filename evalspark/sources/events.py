"""Event logs: JSON lines of (type, id, data), folded, merged, sliced and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.operators.ordering import numbered

ORDER = ("prompt", "inference", "post_process", "eval", "error", "skipped")


def read_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(type, id, data VARIANT, file, line text kept as VARIANT `event`); malformed lines have a null event."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    event = F.try_parse_json("value")
    rows = lines.withColumn("event", event)
    return rows.select(F.try_variant_get("event", "$.type", "string").alias("type"), F.try_variant_get("event", "$.id", "string").alias("id"), F.try_variant_get("event", "$.data", "variant").alias("data"), "event", "file")


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object per line; the committer renames whole files, and _SUCCESS comes last."""
    events.write.mode("append").json(path)


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), kind), F.lit(99))


def merge_shards(shards: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of shards, and the (type, id) pairs that occur more than once, which are errors."""
    union = shards[0]
    for s in shards[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    return union, union.groupBy("type", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def completion(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids of expected without a terminal event, and ids with one that were not expected."""
    done = events.filter(F.col("type").isin("eval", "error", "skipped")).select("id").distinct()
    missing = expected.select("id").join(done, "id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(done.join(expected.select("id"), "id", "left_anti").withColumn("problem", F.lit("unexpected")))


def resume_overlay(samples: DataFrame, events: DataFrame, offset: int = 0) -> DataFrame:
    """Samples (row_id) with their last recorded inference (event id = offset + row), errors left out; null where none."""
    last = events.filter(F.col("type") != "error").groupBy("id").agg(F.max_by("data", "seq").alias("recorded"))
    return samples.join(last.withColumn("row_id", F.col("id").cast("long") - offset).drop("id"), "row_id", "left")


#: Types that end a sample's run.
TERMINAL = ("eval", "error", "skipped")


def fold(events: DataFrame, types: tuple[str, ...] = ORDER, data: str = "data", seq: str = "seq") -> DataFrame:
    """A row per id with the last data of each type, in order of seq."""
    return events.groupBy("id").agg(*[F.max_by(data, F.when(F.col("type") == t, F.col(seq))).alias(t) for t in types])


def ordered(events: DataFrame) -> DataFrame:
    """Events by id, then by the order of types."""
    return events.orderBy("id", type_rank(F.col("type")))


def score_rows(events: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The rows that are aggregated: eval and error events outside the excluded capabilities; an error counts as a
    failure and not as a timeout unless it says otherwise."""
    kept = events.filter(F.col("type").isin("eval", "error"))
    if "capability" in events.columns and excluded:
        kept = kept.filter(~F.coalesce(F.col("capability").isin(*excluded), F.lit(False)))
    default = lambda c, v: F.coalesce(F.col(c) if c in events.columns else F.lit(None).cast("int"), F.when(F.col("type") == "error", v))
    return kept.withColumn("failure", default("failure", 1)).withColumn("timeout", default("timeout", 0))


def overlaid(dimension: Column, value: Column) -> dict[str, Column]:
    """An event's value over the dimension of the same name, and whether the two contradict each other."""
    conflict = F.coalesce((dimension.cast("string") != "") & (value.cast("string") != "") & (dimension != value), F.lit(False))
    return {"value": F.coalesce(value, dimension), "conflict": conflict}


def completion_report(events: DataFrame, count: int, start: int = 0, required: tuple[str, ...] = ("prompt", "inference", "post_process", "eval")) -> DataFrame:
    """(problem, type, id, n): missing, duplicate and unexpected events of ids start to start + count - 1, and errors."""
    spark = events.sparkSession
    seen = events.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    wanted = spark.range(start, start + count).select("id", F.explode(F.array(*map(F.lit, required))).alias("type"))
    problem = lambda df, name, kind=F.col("type"), n=F.col("n"): df.select(F.lit(name).alias("problem"), kind.alias("type"), "id", n.cast("long").alias("n"))  # noqa: E731, B008
    outside = events.filter(~F.col("id").between(start, start + count - 1)).select("id").distinct()
    return (
        problem(wanted.join(seen, ["id", "type"], "left_anti"), "missing", n=F.lit(0))
        .unionByName(problem(seen.filter(F.col("type").isin(*required) & (F.col("n") > 1)), "duplicate"))
        .unionByName(problem(outside, "unexpected", F.lit(None).cast("string"), F.lit(0)))
        .unionByName(problem(seen.filter("type = 'error'"), "error"))
    )


#: Parts in which a problem's ids are ranked.
PARTS = 64


def first_of_each(report: DataFrame, most: int = 20) -> DataFrame:
    """(problem, type, total, ids): how many there are of each problem, and the first ids."""
    # ids are thinned out in parts before they meet: at most `most` of each part are collected
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    kept = report.withColumn("_rank", F.row_number().over(Window.partitionBy("problem", "type", part).orderBy("id"))).filter(F.col("_rank") <= most)
    first = kept.groupBy("problem", F.coalesce("type", F.lit("")).alias("_type")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))
    total = report.groupBy("problem", "type").agg(F.count(F.lit(1)).alias("total")).withColumn("_type", F.coalesce("type", F.lit("")))
    return total.join(first, ["problem", "_type"]).select("problem", "type", "total", "ids")


def row_slice(rows: DataFrame, order: list[str], offset: int, limit: int = 0) -> DataFrame:
    """Rows offset to offset + limit - 1 in order; a limit of 0 has no end."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    out = numbered(rows, order)
    return out.filter((F.col("id") >= offset) & ((F.col("id") < offset + limit) if limit else F.lit(True))).drop("id")


def run_summary(samples: DataFrame, events: DataFrame) -> DataFrame:
    """One row of a run's rates over all its samples (id): n, failed (with an error event), skipped_count (skipped, not
    failed), failure_rate, fail_rate(%d) in per cent and skip_rate; rates of no samples are 0."""
    of = lambda kind: F.max(F.when(F.col("type") == kind, 1).otherwise(0))
    per = events.groupBy("id").agg(of("error").alias("e"), of("skipped").alias("s"))
    counted = samples.select("id").join(per, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") == 1).alias("failed"), F.count_if((F.col("s") == 1) & (F.col("e") == 0)).alias("skipped_count"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    return counted.select("*", share("failed").alias("failure_rate"), (100 * share("failed")).alias("fail_rate(%d)"), share("skipped_count").alias("skip_rate"))


def first_ids(events: DataFrame, n: int) -> DataFrame:
    """The events of the n smallest ids: a report's beginning, so n is small."""
    return events.join(F.broadcast(events.select("id").distinct().orderBy("id").limit(n)), "id", "left_semi")
