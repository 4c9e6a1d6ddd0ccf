"""Operator 10, mixing sources to target weights by nested hash-threshold histograms.

Each document gets a hash; a source's documents under a threshold are taken once more than the rest. Tokens are
summed by source and hash bucket, the bucket in which the budget ends is found, and only that bucket is refined by
the next digits of the hash, until the threshold is exact. Then one filter takes the documents: nothing is sorted,
and no source meets in one task, as sums combine on the map side.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source without words
has target 0, takes no words, and its rows, which cost nothing, stay once; rows that repeat a document id share its
hash and so its fate, and a null id hashes like the empty text; an empty table gives an empty mix; further columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.shared import BLANK_RUN, fresh, materialise

#: Hexadecimal digits per level, and levels: 4096 buckets a source and level, 48 bits in all.
DIGITS, LEVELS = 3, 4
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Sources up to this number are broadcast with their thresholds (about 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, BLANK_RUN), lambda w: w != "")), F.lit(0)).cast("long")


def hash_digits(key: Column) -> Column:
    """The first 48 bits of md5 over the key's text as hexadecimal digits; a null key hashes like the empty text."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row per source: source_size and target.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; a target over `most`
    times its source's size stops there and the excess is shared again by weight. That is filling vessels of
    capacity most * size to one level per weight: with sources by capacity / weight, the first k are full.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    # a row per source is all that meets in one task here
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).isNull(), F.col(source))
    everything = Window.partitionBy(F.lit(0))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / weight_left).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    # the level of the first source that is not full holds for all that are not; after it the levels fall
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))
    return per.select(F.col(source), "source_size", target.alias("target"))


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df


def thresholds(sizes: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """A row per source: base (times every document is taken) and cut (documents of hash <= cut once more).

    cut is null where no document is taken once more. At the last level a bucket is one hash value, and the cut is
    before or after it, whichever leaves the sum nearer to the budget (before it on a tie).
    """
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    state = plan.withColumn("base", F.floor(ratio + 1e-12).cast("long"))
    state = state.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size")))
    state = state.withColumns({"prefix": F.lit(""), "below": F.lit(0.0), "cut": F.lit(None).cast("string")})
    state = materialise(state, "mix-plan")
    n_sources = state.count()
    for level in range(1, LEVELS + 1):
        known = state.select(F.col(source).alias("_of"), "prefix", "below", "budget")
        inside = sizes.join(_small(known, n_sources), sizes[source].eqNullSafe(F.col("_of")))
        inside = inside.filter(F.col("h").startswith(F.col("prefix")))
        bucket = F.substring("h", 1, DIGITS * level)
        histogram = inside.groupBy("_of", "below", "budget", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        # at most 4096 rows a source
        running = Window.partitionBy("_of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ladder = histogram.withColumn("upto", F.col("below") + F.sum("tokens").over(running))
        over = F.col("upto") > F.col("budget")
        found = ladder.groupBy("_of").agg(
            F.max(F.when(~over, F.col("bucket"))).alias("last_under"),
            F.max(F.when(~over, F.col("upto"))).alias("under"),
            F.min(F.when(over, F.col("bucket"))).alias("first_over"),
            F.min(F.when(over, F.col("upto"))).alias("over"),
        )
        state = state.join(_small(found, n_sources), state[source].eqNullSafe(F.col("_of")), "left")
        # buckets wholly within the budget are taken up to their last possible hash
        cut = F.coalesce(F.rpad("last_under", DIGITS * LEVELS, "f"), F.col("cut"))
        below = F.coalesce("under", "below")
        if level == LEVELS:
            nearer = (F.col("over") - F.col("budget")) < (F.col("budget") - below)
            cut = F.when(nearer, F.col("first_over")).otherwise(cut)
        # where nothing is over the budget, nothing is left to refine: no hash starts with "-"
        prefix = F.coalesce("first_over", F.lit("-"))
        state = state.select(source, "source_size", "target", "base", "budget", prefix.alias("prefix"), below.alias("below"), cut.alias("cut"))
        state = materialise(state, f"mix-level{level}")
    return state.select(source, "source_size", "target", "base", "cut")


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h) of every row: all that the mix needs, written once."""
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), n_words(docs[text]).alias("size"))
    return materialise(narrow.withColumn("h", hash_digits(F.col("doc_id"))), "mix-sizes")


def copies(base: Column, cut: Column, h: Column) -> Column:
    """How many times a document is taken."""
    return (base + F.when(cut.isNotNull() & (h <= cut), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs by the mix: rows of a document as often as it is taken, with the columns of docs."""
    sizes = measure(docs, doc_id, text, source)
    of, base, cut, copy = fresh(docs.columns, "_source", "_base", "_cut", "_copy")
    cuts = thresholds(sizes, targets(sizes)).select(F.col("source").alias(of), F.col("base").alias(base), F.col("cut").alias(cut))
    joined = docs.join(_small(cuts, cuts.count()), docs[source].eqNullSafe(cuts[of]))
    times = F.array_repeat(F.lit(0), copies(cuts[base], cuts[cut], hash_digits(docs[doc_id])).cast("int"))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(times).alias(copy)).drop(copy)


def report(docs: DataFrame) -> DataFrame:
    """A row per document: size, source_size, target of its source, and the words that the mix takes of it."""
    sizes = measure(docs)
    cuts = thresholds(sizes, targets(sizes)).withColumnRenamed("source", "_source")
    joined = sizes.join(_small(cuts, cuts.count()), F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * copies(F.col("base"), F.col("cut"), F.col("h"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
