"""Order without one task that holds it: row numbers, scans over long keys, samples of exactly n rows, lines of files.

Rows are dealt by ranges of all ordering columns, so ties in the first one spread too, and written once with their range
and their place in it; whatever runs over all rows is then a sum over one row per range, or per key and range. A key
with all rows uses all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import scratch

#: The bits of monotonically_increasing_id that count within a partition.
_PLACE_BITS = 33


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """rows with _part, the number of their range in `order` (nulls first), and _place, theirs in it from 0."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # written, as another run of the same plan may deal other ranges
    return written(dealt.select(*rows.columns, F.shiftright("_id", _PLACE_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place")), "ranges")


def numbered(rows: DataFrame, order: list[str], offset: int = 0, parts: int | None = None) -> DataFrame:
    """rows with id = offset + place in that order. Ties in all columns are numbered in any order."""
    cut = ranged(rows, order, parts)
    # a row per range
    before = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(before), "_part").withColumn("id", F.col("_place") + F.col("_before") + offset).drop("_part", "_place", "_before")


def _carried(cut: DataFrame, key: list[str], summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """cut (with _part) with columns `carry`, each over the `summary` of a key's earlier ranges; null in its first one.

    carry's Columns are window functions by name of a summary column, to be run over the ranges of a key in order.
    """
    same = F.struct(*key).alias("_key") if key else F.struct(F.lit(0)).alias("_key")
    sums = cut.groupBy(same, "_part").agg(*[c.alias(n) for n, c in summary.items()])
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = sums.select("_key", "_part", *[c.over(earlier).alias(n) for n, c in carry.items()])
    return cut.withColumn("_key", F.struct(*key) if key else F.struct(F.lit(0))).join(found, ["_key", "_part"]).drop("_key")


def gap_merge(rows: DataFrame, key: list[str], start: str, end: str, gap: float, parts: int | None = None) -> DataFrame:
    """Intervals of one key merged where the next begins up to `gap` after the latest end so far: key, start, end, n."""
    cut = ranged(rows, [*key, start, end], parts)
    within = Window.partitionBy("_part", *key).orderBy("_place")
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    reached = _carried(cut, key, {"_end": F.max(end)}, {"_reach": F.max("_end")})
    before = F.greatest("_reach", F.max(end).over(so_far))
    marked = reached.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)).drop("_reach")
    counted = _carried(marked, key, {"_some": F.sum("_new")}, {"_islands": F.sum("_some")})
    island = F.coalesce("_islands", F.lit(0)) + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_island", island).groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def with_runs(rows: DataFrame, key: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """rows with run: the number, from 1, of the run of equal values (nulls are equal) that they belong to in their key."""
    cut = ranged(rows, [*key, *order], parts)
    within = Window.partitionBy("_part", *key).orderBy("_place")
    boxed = F.struct(F.col(value).alias("v"))
    last = _carried(cut, key, {"_last": F.max_by(boxed, "_place")}, {"_held": F.last("_last")})
    # a struct tells a null value from no row
    earlier = F.coalesce(F.lag(boxed).over(within), F.col("_held"))
    marked = last.withColumn("_new", (earlier.isNull() | ~F.col(value).eqNullSafe(earlier["v"])).cast("int")).drop("_held")
    counted = _carried(marked, key, {"_some": F.sum("_new")}, {"_runs": F.sum("_some")})
    run = F.coalesce("_runs", F.lit(0)) + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("run", run).drop("_new", "_runs", "_part", "_place")


def runs(rows: DataFrame, key: list[str], order: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Runs of equal values in order: key, value, run number from 1 and length."""
    return with_runs(rows, key, order, value, parts).groupBy(*key, "run", value).agg(F.count(F.lit(1)).alias("length"))


#: Hexadecimal digits of a hash that one round of exact_sample looks at: as many buckets as 16 to that power.
DIGITS = 3


def sample_hash(key: Column, seed: int) -> Column:
    """What decides whether a row is drawn: md5 of its key and the seed, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)).cast("binary"))


def exact_sample(rows: DataFrame, key: str, n: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """The n rows of the smallest hashes, ties by key: the same ones in every run. A sampling operator.

    Rows are counted by the first digits of the hash; the bucket in which the n-th falls is counted by the next digits,
    until it has few rows, and one filter takes what is below. Nothing is sorted but the rows of that last bucket, whose
    hashes share all digits looked at. With fewer than n rows, all are taken, or it is an error if strict.
    """
    hashed = rows.withColumn("_h", sample_hash(F.col(key), seed))
    if n <= 0:
        return rows.limit(0)
    prefix, taken = "", 0
    for level in range(1, 32 // DIGITS):
        bucket = F.substring("_h", 1, DIGITS * level)
        # at most 16 ** DIGITS rows
        counts = sorted(hashed.filter(F.col("_h").startswith(prefix)).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        if level == 1 and sum(r.n for r in counts) <= n:
            if strict and sum(r.n for r in counts) < n:
                raise ValueError(f"{n} rows asked for, {sum(r.n for r in counts)} are there")
            return rows
        for b, many in counts:
            prefix = b
            if taken + many > n:
                break
            taken += many
        else:
            many = 0
        if taken + many <= n or many <= EDGE_ROWS:
            break
    below = hashed.filter(F.substring("_h", 1, len(prefix)) < prefix)
    edge = hashed.filter(F.substring("_h", 1, len(prefix)) == prefix)
    # rows of equal hash are copies of a key: any of them will do
    return below.unionByName(edge.orderBy("_h", key).limit(n - taken)).drop("_h") if n > taken else below.drop("_h")


def stride_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at even distances in that order, from the first on; all rows if there are no more than n. A sampling
    operator."""
    total = rows.count()
    if total <= n:
        return rows
    step = total // n
    return numbered(rows, order).filter((F.col("id") % step == 0) & (F.col("id") < n * step)).drop("id")


#: Rows of the last bucket of exact_sample that may be sorted in one task.
EDGE_ROWS = 10_000


def lines(spark: SparkSession, path: str | list[str], split_bytes: int = 64 << 20) -> DataFrame:
    """(file, line, value) of text files: line numbers from 0 in each file, in the file's order.

    A file's splits are numbered by their first byte; their numbers of lines, a row per split, give each split's first
    line number. Lines are numbered within their split as they are read, so nothing is ordered.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_id"))
    rows = written(read, "lines")
    splits = rows.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    order = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return rows.join(starts, ["file", "_split"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"), "value")


def attach_by_position(rows: DataFrame, recorded: DataFrame, on: list[str], position: str = "line") -> DataFrame:
    """rows (on, position) beside the recorded value at the same position of the same file; a position without one has
    null. ValueError where recorded holds positions that rows lack: files of different length don't belong together."""
    extra = recorded.join(rows, [*on, position], "left_anti").limit(1).count()
    if extra:
        raise ValueError("the recorded file has more lines than the rows that it is attached to")
    return rows.join(recorded, [*on, position], "left")
