"""Joins with rules for several matches and for none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(samples: DataFrame, catalog: DataFrame, record_id: str, keys: list[str], payload: list[str]) -> DataFrame:
    """samples with the payload of their catalog record and `found`: by `record_id` if they name one, else by all keys.

    found is id, keys, ambiguous (several records of the keys), incomplete (a key is missing) or missing; only the
    first two have a payload. A named record is never replaced by one of equal keys.
    """
    value = F.struct(*payload)
    by_id = catalog.groupBy(F.col(record_id)).agg(F.min(value).alias("_by_id"))
    by_keys = catalog.groupBy(*keys).agg(F.min(value).alias("_by_keys"), F.count(F.lit(1)).alias("_n"))
    named = F.coalesce(F.col(record_id).cast("string") != "", F.lit(False))
    incomplete = F.greatest(*[F.coalesce(F.col(k).cast("string") == "", F.lit(True)) for k in keys], F.lit(False))
    joined = samples.join(by_id, record_id, "left").join(by_keys, keys, "left")
    found = (
        F.when(named & F.col("_by_id").isNotNull(), "id").when(named, "missing").when(incomplete, "incomplete")
        .when(F.col("_n") == 1, "keys").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    )
    out = joined.withColumn("found", found)
    picked = F.when(F.col("found") == "id", F.col("_by_id")).when(F.col("found") == "keys", F.col("_by_keys"))
    return out.select(*[out[c] for c in samples.columns], *[picked[p].alias(p) for p in payload], "found")


def first_candidate(samples: DataFrame, index: DataFrame, sample_id: str, keys: Column) -> DataFrame:
    """(sample_id, key, path, found): the first of a sample's keys that the index (key, path) has. One path: attached;
    several: ambiguous; no key with any: missing."""
    n = index.groupBy("key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    each = samples.select(F.col(sample_id), F.posexplode(keys).alias("pos", "key")).join(n, "key")
    first = each.groupBy(sample_id).agg(F.min(F.struct("pos", "key", "path", "n")).alias("m"))
    out = samples.select(sample_id).join(first, sample_id, "left")
    found = F.when(F.col("m").isNull(), "missing").when(F.col("m.n") > 1, "ambiguous").otherwise("attached")
    return out.select(sample_id, F.col("m.key").alias("key"), F.when(F.col("m.n") == 1, F.col("m.path")).alias("path"), found.alias("found"))


def fill(rows: DataFrame, target: str, sources: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """rows with missing values of target filled from the first source (name, table of key and value, key of the row)
    that has one, and the name in <target>_source; values that are there stay, without a source."""
    out, names = rows, []
    for k, (name, table, key) in enumerate(sources):
        one = table.groupBy(F.col("key").alias(f"_key{k}")).agg(F.min("value").alias(f"_value{k}"))
        out = out.withColumn(f"_on{k}", key).join(one, F.col(f"_on{k}") == F.col(f"_key{k}"), "left")
        names.append((name, f"_value{k}"))
    there = F.coalesce(F.trim(F.col(target)) != "", F.lit(False))
    filled = F.when(there, F.col(target)).otherwise(F.coalesce(*[F.col(c) for _, c in names]))
    source = reduce(lambda w, nc: w.when(F.col(nc[1]).isNotNull(), nc[0]), names, F.when(there, None))
    keep = [F.col(c) for c in rows.columns if c != target]
    return out.select(*keep, filled.alias(target), source.alias(f"{target}_source"))


def pivoted(rows: DataFrame, key: list[str], name: str, value: str, names: tuple[str, ...]) -> DataFrame:
    """A row per key with a column per name; names are listed, so nothing is scanned to find them."""
    return rows.groupBy(*key).pivot(name, list(names)).agg(F.max(value))


def agreement(tracks: DataFrame, cell: list[str], a: str, b: str, close: float = 20.0) -> DataFrame:
    """Per cell of pivoted tracks: n, paired n, shares of equal and of close scores, and the mean difference."""
    both, apart = F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) - F.col(b)
    share = lambda c: F.avg(F.when(both, c.cast("double")))
    return tracks.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("paired"), share(apart == 0).alias("exact"), share(F.abs(apart) <= close).alias("close"), F.avg(F.when(both, apart)).alias("mean_delta"))


def caption_references(samples: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """samples with the captions of their path, null where the index has none. index: audio_path, audio_filepath, captions
    (an array), line; either path finds a row, missing captions don't count, and of several rows the later one does."""
    given = index.withColumn("_c", F.filter("captions", lambda c: c.isNotNull() & (c != ""))).filter("size(_c) > 0")
    keys = given.select(F.explode(F.array("audio_path", "audio_filepath")).alias(path), "_c", "line").filter(F.col(path) != "")
    return samples.join(keys.groupBy(path).agg(F.max_by("_c", "line").alias("captions")), path, "left")


def control_free(text: Column) -> Column:
    """Text without control characters, as spreadsheets need it."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", "")


def clipped_cell(text: Column, most: int = 32_767, mark: str = "...[truncated]") -> Column:
    """Text that fits a spreadsheet's cell."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(mark))), F.lit(mark))).otherwise(text)
