"""N-gram overlap over corpora: BLEU, chrF and CIDEr from counts that add up over rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
CHAR_ORDERS = (1, 2, 3, 4, 5, 6)


def summed(counts: str) -> list[Column]:
    """The counts of all rows of a group, as columns m1, h1, r1, ..."""
    return [F.sum(f"{counts}.{s}{n}").alias(f"{s}{n}") for n in CHAR_ORDERS for s in "mhr"]


def bleu(sums: dict[str, Column] | None = None) -> Column:
    """BLEU of the columns of `summed`, or of other columns by those names: the geometric mean of four clipped
    precisions, an order without a match counting as half of the one before it, times the brevity penalty."""
    c = sums.__getitem__ if sums else F.col
    precisions, misses = [], F.lit(0)
    for n in ORDERS:
        misses = misses + F.when((c(f"m{n}") == 0) & (c(f"h{n}") > 0), 1).otherwise(0)
        one = F.when(c(f"m{n}") > 0, 100.0 * c(f"m{n}") / c(f"h{n}")).otherwise(F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), misses) * c(f"h{n}")))
        precisions.append(F.when(one.isNull(), F.lit(-9999999999.0)).otherwise(F.log(one)))
    penalty = F.when(c("h1") < c("r1"), F.exp(1 - c("r1") / c("h1"))).otherwise(1.0)
    none = reduce(add, [c(f"m{n}") for n in ORDERS]) == 0
    return F.when(none, 0.0).otherwise(penalty * F.exp(reduce(add, precisions) / 4.0))


def chrf(sums: dict[str, Column] | None = None, beta: float = 2.0) -> Column:
    """chrF of the columns of `summed`, or of other columns by those names: F-beta of mean precision and recall over the
    orders that both sides have."""
    c = sums.__getitem__ if sums else F.col
    both = lambda n: (c(f"h{n}") > 0) & (c(f"r{n}") > 0)
    mean = lambda s: F.try_divide(reduce(add, [F.when(both(n), c(f"m{n}") / c(f"{s}{n}")).otherwise(0.0) for n in CHAR_ORDERS]), reduce(add, [both(n).cast("double") for n in CHAR_ORDERS]))
    p, r = F.coalesce(mean("h"), F.lit(0.0)), F.coalesce(mean("r"), F.lit(0.0))
    return F.coalesce(F.try_divide(100.0 * (1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))


def _of_order(tokens: str, n: int) -> Column:
    """(n, gram) of all n-grams of an array of tokens."""
    one = lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(F.col(tokens), i, n), " ").alias("gram"))
    none = F.array().cast("array<struct<n: int, gram: string>>")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), one)).otherwise(none)


def _grams(rows: DataFrame, tokens: str) -> DataFrame:
    """(id, side, n, gram, tf): n-grams of up to four tokens and how often each stands in its text."""
    every = F.explode(F.flatten(F.array(*[_of_order(tokens, n) for n in ORDERS])))
    return rows.select("id", "side", every.alias("g")).groupBy("id", "side", "g.n", "g.gram").agg(F.count(F.lit(1)).alias("tf"))


def cider(hypotheses: DataFrame, references: DataFrame, sigma: float = 6.0) -> DataFrame:
    """(id, cider) of hypotheses (id, tokens) against one or more references (id, tokens) each.

    n-grams weigh tf times log(N / df), df counting ids whose references have them; similarities are clipped cosines,
    damped by the difference of lengths, averaged over references and orders, times 10.
    """
    side = Window.partitionBy("id").orderBy("tokens")
    h = _grams(hypotheses.select("id", F.lit(0).alias("side"), "tokens"), "tokens")
    r = _grams(references.select("id", F.row_number().over(side).alias("side"), "tokens"), "tokens")
    n_refs = references.groupBy("id").agg(F.count(F.lit(1)).alias("refs"))
    total = float(references.select("id").distinct().count())
    df = r.groupBy("n", "gram").agg(F.count_distinct("id").alias("df"))
    weighed = lambda g: g.join(df, ["n", "gram"], "left").withColumn("w", F.col("tf") * F.log(F.lit(total) / F.coalesce("df", F.lit(1))))
    hw, rw = weighed(h), weighed(r)
    size = lambda g, p: g.groupBy("id", "side", "n").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias(f"{p}_norm"))
    length = lambda g, p: g.groupBy("id", "side").agg(F.sum(F.when(F.col("n") == 2, F.col("tf")).otherwise(0)).alias(f"{p}_len"))
    met = hw.select("id", "n", "gram", F.col("w").alias("hw")).join(rw.select("id", "side", "n", "gram", F.col("w").alias("rw")), ["id", "n", "gram"])
    dots = met.groupBy("id", "side", "n").agg(F.sum(F.least("hw", "rw") * F.col("rw")).alias("dot"))
    out = dots.join(size(rw, "r"), ["id", "side", "n"]).join(size(hw, "h").drop("side"), ["id", "n"]).join(length(rw, "r"), ["id", "side"]).join(length(hw, "h").drop("side"), "id")
    cosine = F.when((F.col("h_norm") > 0) & (F.col("r_norm") > 0), F.col("dot") / (F.col("h_norm") * F.col("r_norm"))).otherwise(F.col("dot"))
    sums = out.groupBy("id").agg(F.sum(cosine * F.exp(-((F.col("h_len") - F.col("r_len")) ** 2) / (2 * sigma**2))).alias("s"))
    return n_refs.join(sums, "id", "left").select("id", (10.0 * F.coalesce("s", F.lit(0.0)) / (len(ORDERS) * F.col("refs"))).alias("cider"))
