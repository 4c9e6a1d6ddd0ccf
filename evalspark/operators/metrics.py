"""Corpus metrics as aggregates that combine on the map side: rates, F1, ROC, percentiles, slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Sum over sum; null where the denominator is zero."""
    return F.try_divide(F.sum(numerator).cast("double"), F.sum(denominator).cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Pairs without a value are dropped with their weight."""
    return ratio(F.when(value.isNotNull(), value * weight), F.when(value.isNotNull(), weight))


def _rows(weight: str | None) -> Column:
    """How many rows there are, each standing for `weight` of them if that is given."""
    return F.sum(weight) if weight else F.count(F.lit(1))


def macro_f1(rows: DataFrame, predicted: str, reference: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """Mean F1 over all labels seen on either side, from one count per pair of labels."""
    pairs = rows.groupBy(*keys, F.col(predicted).cast("string").alias("p"), F.col(reference).cast("string").alias("r")).agg(_rows(weight).alias("n"))
    side = lambda c, is_p, hit: F.struct(F.col(c).alias("label_"), F.lit(is_p).alias("is_p"), hit.alias("hit"))
    sides = pairs.select(*keys, "n", F.inline(F.array(side("p", 1, F.col("p").eqNullSafe(F.col("r")).cast("int")), side("r", 0, F.lit(0)))))
    per = sides.groupBy(*keys, "label_").agg(F.sum(F.col("hit") * F.col("n")).alias("tp"), F.sum(F.col("is_p") * F.col("n")).alias("np"), F.sum((1 - F.col("is_p")) * F.col("n")).alias("nr"))
    return per.groupBy(*keys).agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("np") + F.col("nr")), F.lit(0.0))).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def pairwise(predicted: str, reference: str) -> dict[str, Column]:
    """The share of rows whose predicted score is higher, in per cent, and both means."""
    return {"win_pct": 100.0 * F.avg((F.col(predicted) > F.col(reference)).cast("double")), "ref_score": F.avg(reference), "pred_score": F.avg(predicted)}


def covered(predicted: Column, reference: Column) -> Column:
    """A predicted amount over a reference amount of at least 1."""
    return predicted / F.greatest(reference, F.lit(1))


#: Buckets per unit of log(1 + |value|) that ordered values fall into: values within some 65,536th of one another share
#: one, and what a task orders is a bucket's distinct values.
LOG_BUCKETS = 65_536


def log_bucket(value: Column) -> Column:
    """A bucket that never falls as the value grows; not-a-number is the greatest value."""
    return F.when(F.isnan(value), F.lit(2**62)).otherwise(F.floor(F.signum(value) * F.log1p(F.abs(value)) * LOG_BUCKETS)).cast("long")


def running(per: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """per (a row per keys and value) with <c>_upto and <c>_all for each column c of sums: its sum over the values of
    these keys up to this one, and over all of them.

    Values are ordered within buckets, and buckets by their sums: no task orders all values of a key, and no job runs
    while the plan is made.
    """
    cut = per.withColumn("_k", F.struct(*keys) if keys else F.struct(F.lit(0))).withColumn("_b", log_bucket(F.col(value)))
    totals = cut.groupBy("_k", "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    # a row per key and bucket
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums], *[F.sum(f"_{c}").over(Window.partitionBy("_k")).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy("_k", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, ["_k", "_b"]).select(*per.columns, *[(F.sum(c).over(inside) + F.col(f"_{c}_before")).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums])


def roc(rows: DataFrame, score: str, label: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """(keys, score, pos, neg, pos_ge, neg_ge, n_pos, n_neg) per distinct score: one row each, however many samples
    share it. Rows without a score or a label of 0 or 1 are left out."""
    y, m = F.col(label).cast("long"), F.col(weight) if weight else F.lit(1)
    known = rows.filter(F.col(score).isNotNull() & y.isin(0, 1))
    per = known.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(y * m).alias("pos"), F.sum((1 - y) * m).alias("neg"))
    at_least = lambda c: (F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)).alias(f"{c}_ge")
    return running(per, keys, "score", ["pos", "neg"]).select(*keys, "score", "pos", "neg", at_least("pos"), at_least("neg"), F.col("pos_all").alias("n_pos"), F.col("neg_all").alias("n_neg"))


def verification(rows: DataFrame, score: str, label: str, keys: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """(keys, auc, eer, threshold) from one curve: wins plus half of ties over all pairs of positives and negatives, by
    cumulated counts instead of pairs; and the equal error rate at the first threshold, from above, at which the rates
    are nearest."""
    wins = F.col("pos") * (F.col("n_neg") - F.col("neg_ge") + F.col("neg") / 2.0)
    far, frr = F.try_divide(F.col("neg_ge"), F.col("n_neg")), F.try_divide(F.col("n_pos") - F.col("pos_ge"), F.col("n_pos"))
    best = F.min(F.struct(F.round(F.abs(far - frr), 12).alias("gap"), (-F.col("score")).alias("order"), ((far + frr) / 2).alias("eer")))
    found = roc(rows, score, label, keys, weight).groupBy(*keys).agg(F.try_divide(F.sum(wins), F.max(F.col("n_pos") * F.col("n_neg"))).alias("auc"), best.alias("b"))
    return found.select(*keys, "auc", F.col("b.eer").alias("eer"), (-F.col("b.order")).alias("threshold"))


def auc(rows: DataFrame, score: str, label: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, auc)."""
    return verification(rows, score, label, keys).select(*keys, "auc")


def eer(rows: DataFrame, score: str, label: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, eer, threshold)."""
    return verification(rows, score, label, keys).select(*keys, "eer", "threshold")


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, v, m): how often each value occurs; missing values are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))


def percentiles(counts: DataFrame, keys: list[str], name: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95), expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(keys, <name>_p50, ...) of a histogram (v, m and further columns): by linear interpolation at (n - 1) q.

    `expand`, if given, gives rows of the histogram their keys, once per key that they count for. It first sees sums by
    bucket of value, which tell in which buckets the ranks fall, then only those buckets' values. Windows run over
    buckets, and over the distinct values of a bucket; equal values are one row, however many there are.
    """
    by = [c for c in counts.columns if c not in ("v", "m")]
    cut = counts.withColumn("_b", log_bucket(F.col("v")))
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    sizes = (cut if expand is None else expand(cut.groupBy(*by, "_b").agg(F.sum("m").alias("m")))).groupBy(key.alias("_k"), "_b").agg(F.sum("m").alias("m"))
    before = lambda part, order: F.coalesce(F.sum("m").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"before": before(["_k"], "_b"), "n": F.sum("m").over(Window.partitionBy("_k"))})
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = [f(at(q)) for q in shares for f in (F.floor, F.ceil)]
    inside = F.greatest(*[(r >= F.col("before")) & (r < F.col("before") + F.col("m")) for r in ranks], F.lit(False))
    needed = sizes.filter(inside).drop("m")
    near = cut if expand is None else expand(cut.join(needed.select("_b").distinct(), "_b", "left_semi"))
    values = near.withColumn("_k", key).join(needed, ["_k", "_b"]).groupBy("_k", "_b", "v", "before", "n").agg(F.sum("m").alias("m"))
    ranked = values.withColumn("before", F.col("before") + before(["_k", "_b"], "v"))
    picked = [F.max(F.when((r >= F.col("before")) & (r < F.col("before") + F.col("m")), F.col("v"))).alias(f"v{k}") for k, r in enumerate(ranks)]
    out = ranked.groupBy("_k", "n").agg(*picked)
    # the nearer rank alone where the share is whole: an infinite neighbour times 0 is no number
    def between(k: int, q: float) -> Column:
        low, high, share = F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}"), at(q) - F.floor(at(q))
        return F.when((share == 0) | (low == high), low).otherwise(low * (1 - share) + high * share)

    return out.select(*[F.col("_k")[c].alias(c) for c in keys], *[between(k, q).alias(f"{name}_p{round(100 * q)}") for k, q in enumerate(shares)])


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95)) -> DataFrame:
    """(keys, <value>_p50, ...) of rows; missing values are left out."""
    return percentiles(histogram(rows, keys, value), keys, value, shares)
