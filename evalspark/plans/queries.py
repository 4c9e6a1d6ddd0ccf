"""The library's operators as queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions import instructions as I
from evalspark.functions import process as P
from evalspark.functions import text as T
from evalspark.functions import text_udf as U
from evalspark.operators import cube, intervals, metrics
from evalspark.plans.catalog import REGISTERED, query, r6
from evalspark.session import table
from evalspark.streaming import events as streams

#: Modules that register further queries.
SISTERS = ("text_queries", "score_queries", "cube_queries", "event_queries", "join_queries", "label_queries", "sample_queries", "schema_queries", "report_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries, those of the sister modules included."""
    for module in SISTERS:
        import_module(f"evalspark.plans.{module}")
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}


# The flagship: score rows (events: value is latency, `error` is a failure) over grouping sets.


@query(r"""
WITH s AS (SELECT event_type, cast(user_id % 10 AS VARCHAR) AS cohort, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failure FROM events),
g AS (
  SELECT 'overall' AS slice, 'all' AS label, * FROM s UNION ALL SELECT 'event_type', event_type, * FROM s
  UNION ALL SELECT 'cohort', cohort, * FROM s UNION ALL SELECT 'event_type+cohort', event_type || '+' || cohort, * FROM s)
SELECT slice, label, count(*)::BIGINT AS sample_count, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.5), 6) AS value_p50,
  round(quantile_cont(value, 0.95), 6) AS value_p95, round(avg(failure), 6) AS failure_rate, CASE WHEN count(*) < 5 THEN 'small_sample' END AS warning
FROM g WHERE label IS NOT NULL GROUP BY slice, label""")
def cube_slices(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_type", (F.col("user_id") % 10).cast("string").alias("cohort"), "value", (F.col("event_type") == "error").cast("int").alias("failure"))
    cuboid = cube.Cuboid(rows, [["event_type"], ["cohort"], ["event_type", "cohort"]])
    base = cuboid.flat.groupBy(*cuboid.by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.count("value").alias("m"), F.sum("failure").alias("f"))
    out = cuboid.expand(base).groupBy("slice", "label").agg(F.sum("n").alias("sample_count"), r6(F.sum("v") / F.sum("m")).alias("mean_value"), r6(F.sum("f") / F.sum("n")).alias("failure_rate"))
    p = metrics.percentiles(metrics.histogram(cuboid.flat, cuboid.by, "value"), ["slice", "label"], "value", (0.5, 0.95), cuboid.expand)
    label = F.when(F.col("slice") == "overall", "all").otherwise(F.replace("label", F.lit("|"), F.lit("+"))).alias("label")
    warning = F.when(F.col("sample_count") < 5, "small_sample").alias("warning")
    return out.join(p, ["slice", "label"], "left").select("slice", label, "sample_count", "mean_value", r6(F.col("value_p50")).alias("value_p50"), r6(F.col("value_p95")).alias("value_p95"), "failure_rate", warning)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.9), 6) AS value_p90, round(quantile_cont(value, 0.95), 6) AS value_p95 FROM events GROUP BY event_type")
def runtime_percentiles(spark, sf_dir):
    p = metrics.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", (0.5, 0.9, 0.95))
    return p.select("event_type", *(r6(F.col(c)).alias(c) for c in p.columns[1:]))


@query("SELECT event_type, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def failure_counts(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query("SELECT user_id % 10 AS cohort, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, count(*)::BIGINT AS n FROM events GROUP BY 1")
def failure_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("cohort")).agg(r6(F.avg((F.col("event_type") == "error").cast("double"))).alias("failure_rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_discount)::DOUBLE / sum(l_extendedprice)::DOUBLE, 6) AS rate, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def ratio_of_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(r6(metrics.ratio(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"))).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity)::DOUBLE / sum(l_quantity)::DOUBLE, 6) AS weighted FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(metrics.weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("weighted"))


@query("SELECT lang, round(100 * avg(quality), 6) AS quality_pct, round(100 * avg(toxic), 6) AS toxic_pct, count(*)::BIGINT AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def naive_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(r6(100 * F.avg("quality")).alias("quality_pct"), r6(100 * F.avg("toxic")).alias("toxic_pct"), F.count(F.lit(1)).alias("n"))


@query("SELECT lang, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def acc_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(r6(F.avg((F.col("quality") == F.col("toxic")).cast("double"))).alias("acc"))


@query(r"""
WITH u AS (SELECT toxic AS label, 1 AS is_p, (toxic = quality)::INT AS hit FROM labels UNION ALL SELECT quality, 0, 0 FROM labels),
per AS (SELECT label, sum(hit) AS tp, count(*) AS n FROM u GROUP BY label)
SELECT round(avg(coalesce(2.0 * tp / nullif(n, 0), 0)), 6) AS macro_f1, count(*)::BIGINT AS labels FROM per""")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(table(spark, sf_dir, "labels"), "toxic", "quality").withColumn("macro_f1", r6(F.col("macro_f1")))


_SCORED = "WITH s AS (SELECT n_chars::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id))"


@query(_SCORED + r""", per AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
c AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM per)
SELECT round(sum(p * (below + n / 2.0)) / max(np * nn), 6) AS auc FROM c""")
def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.auc(rows, "n_chars", "quality").withColumn("auc", r6(F.col("auc")))


@query(_SCORED + r""", per AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY score),
c AS (SELECT score, sum(n) OVER w / sum(n) OVER () AS far, 1 - sum(p) OVER w / sum(p) OVER () AS frr FROM per WINDOW w AS (ORDER BY score DESC))
SELECT round((far + frr) / 2, 6) AS eer, score AS threshold FROM c ORDER BY round(abs(far - frr), 12), score DESC LIMIT 1""")
def eer(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.eer(rows, "n_chars", "quality").select(r6(F.col("eer")).alias("eer"), "threshold")


@query("SELECT count(*)::BIGINT AS sample_count, count(quality)::BIGINT AS known_count, (count(*) - count(quality))::BIGINT AS missing_count, round(count(quality) / count(*), 6) AS known_rate, lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, known = F.count(F.lit(1)), F.count("quality")
    return rows.groupBy("lang").agg(n.alias("sample_count"), known.alias("known_count"), (n - known).alias("missing_count"), r6(known / n).alias("known_rate"))


# Joins and set operations.


@query("SELECT o_orderkey, o_orderstatus, coalesce(n_lines, 0)::BIGINT AS n_lines, last_part FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n_lines, max({'n': l_linenumber, 'p': l_partkey}).p AS last_part FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1) ON k = o_orderkey")
def resume_overlay_left(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linestatus <> 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("last_part"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"), "last_part")


@query("SELECT r_name, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def dim_lookup(spark, sf_dir):
    """Nations and regions are small tables of a fixed size; the planner broadcasts them by their statistics."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labeled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def missing_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT l_partkey AS k FROM lineitem INTERSECT ALL SELECT l_suppkey FROM lineitem")
def multiset_intersect(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").alias("k")).intersectAll(x.select(F.col("l_suppkey").alias("k")))


@query("SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark UNION ALL SELECT page_id, 'page' FROM pages")
def shard_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(k).alias("id"), F.lit(v).alias("kind")) for t, k, v in (("documents", "doc_id", "document"), ("benchmark", "item_id", "benchmark"), ("pages", "page_id", "page"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(r"""
WITH e AS (SELECT event_id AS id, epoch(ts) AS s, epoch(ts) + 600 AS t, event_type FROM events)
SELECT a.id AS a_id, b.id AS b_id, greatest(a.s, b.s)::DOUBLE AS "start", least(a.t, b.t)::DOUBLE AS "end"
FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = 'purchase' AND least(a.t, b.t) - greatest(a.s, b.s) > 0.05""")
def interval_overlap(spark, sf_dir):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), s.alias("start"), (s + 600).alias("end"), "event_type")
    return intervals.overlap_join(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), 1200.0, 0.05)


@query(r"""
WITH m AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, round(min(epoch(ts)), 3) AS s, round(max(epoch(ts)), 3) AS t, count(*)::BIGINT AS n FROM g GROUP BY user_id, island""")
def gap_merge(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf_dir, "events").select("user_id", at.alias("s"), at.alias("t"))
    return intervals.gap_merge(e, ["user_id"], "s", "t", 6 * 3600.0).select("user_id", F.round("s", 3).alias("s"), F.round("t", 3).alias("t"), "n")


@query(r"""
WITH m AS (SELECT user_id, event_type, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT m.*, sum(c) OVER (PARTITION BY m.user_id ORDER BY e.ts, m.event_id ROWS UNBOUNDED PRECEDING) AS run FROM m JOIN events e USING (event_id))
SELECT user_id, run::BIGINT AS run, event_type, count(*)::BIGINT AS length FROM g GROUP BY user_id, run, event_type""")
def run_islands(spark, sf_dir):
    return intervals.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT conv_id, turn, role, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def dialogue_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.array_join(intervals.history(c, "conv_id", "turn", F.col("text")), "\n").alias("history"))


@query(r"""
WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS window_start, ts FROM events)
SELECT epoch(window_start)::BIGINT AS window_start, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds FROM w WHERE ts < window_start + INTERVAL 60 MINUTE GROUP BY window_start HAVING count(DISTINCT event_type) >= 2""")
def hopping_windows(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "60 minutes", "20 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))
    return out.filter("kinds >= 2").select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("window_start"), "n", "kinds")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice::DOUBLE, 4) AS price FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
def topk_delta(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(15).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("double"), 4).alias("price"))


@query("SELECT lang, doc_id, k::BIGINT AS k FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_stratified(spark, sf_dir):
    """A sampling operator: five per stratum by hash; the window's row limit is applied before the shuffle too."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return d.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("lang", "doc_id", F.col("k").cast("long").alias("k"))


@query("SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k FROM events")
def event_json_project(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500")
def view_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").filter("lang = 'en' and n_chars >= 500")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'coverage_debt' WHEN toxic = 1 THEN 'diagnostic_evidence' WHEN quality = 0 THEN 'stress_test' ELSE 'formal_subscores' END AS use_bucket FROM documents LEFT JOIN labels USING (doc_id)")
def bucket_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality").isNull(), "coverage_debt").when(F.col("toxic") == 1, "diagnostic_evidence").when(F.col("quality") == 0, "stress_test").otherwise("formal_subscores")
    return rows.select("doc_id", bucket.alias("use_bucket"))


@query("SELECT doc_id, e AS error FROM (SELECT doc_id, unnest(list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown language' END, CASE WHEN n_chars < 100 THEN 'too short' END, CASE WHEN coalesce(text, '') = '' THEN 'missing text' END], lambda x: x IS NOT NULL)) AS e FROM documents)")
def validation_errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    errors = F.array_compact(F.array(F.when(~F.col("lang").isin("en", "de"), "unknown language"), F.when(F.col("n_chars") < 100, "too short"), F.when(T.nz(F.col("text")).isNull(), "missing text")))
    return d.select("doc_id", F.explode(errors).alias("error"))


@query("SELECT event_type, event_id, round(value, 6) AS value, CASE WHEN event_type = 'error' AND value > 50 THEN 'timeout' WHEN event_type = 'error' THEN 'internal' ELSE 'none' END AS failure_type FROM events")
def failure_taxonomy(spark, sf_dir):
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_type", "event_id", r6(F.col("value")).alias("value"), F.when(error & (F.col("value") > 50), "timeout").when(error, "internal").otherwise("none").alias("failure_type"))


# Text functions and evaluators.


def _sides(conversations: DataFrame) -> DataFrame:
    """(conv_id, r, h): all words of the user's and of the assistant's turns, in the order of the turns."""
    c = conversations.groupBy("conv_id").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"]), " ").alias(n) for role, n in (("user", "u"), ("assistant", "a"))])
    return c.select("conv_id", T.words(F.col("u")).alias("r"), T.words(F.col("a")).alias("h"))


@query(None)
def wer_whole(spark, sf_dir):
    """Word errors of all the assistant's words of a conversation against all the user's, summed."""
    sides = _sides(table(spark, sf_dir, "conversations"))
    return sides.agg(F.sum(U.edit_distance("r", "h")).alias("errors"), F.sum(F.size("r")).alias("reference_words"))


_PAIR = r"""WITH p AS (SELECT a.doc_id, regexp_extract_all(lower(a.text), '\S+') AS x, regexp_extract_all(lower(b.text), '\S+') AS y FROM documents a LEFT JOIN benchmark b ON b.item_id = a.doc_id % (SELECT count(*) FROM benchmark))"""


def _pairs(spark, sf_dir):
    """Every document beside the benchmark item that its id falls on, modulo the number of items."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("reference"))
    return d.withColumn("item_id", F.pmod("doc_id", F.lit(max(b.count(), 1)))).join(b, "item_id", "left").select("doc_id", "text", "reference")


@query(_PAIR + r""", c AS (SELECT doc_id, len(x) AS nx, len(y) AS ny, list_sum(list_transform(list_distinct(y), lambda t: least(len(list_filter(x, lambda s: s = t)), len(list_filter(y, lambda s: s = t)))))::BIGINT AS n FROM p)
SELECT doc_id, CASE WHEN nx = 0 AND ny = 0 THEN 1.0 ELSE round(coalesce(2.0 * coalesce(n, 0) / nullif(nx + ny, 0), 0), 6) END::DOUBLE AS token_f1 FROM c""")
def token_f1(spark, sf_dir):
    p = _pairs(spark, sf_dir).select("doc_id", U.common_words(F.lower("text"), F.lower("reference")).alias("c"))
    return p.select("doc_id", r6(T.f1(F.col("c.common"), F.col("c.n_a"), F.col("c.n_b"))).alias("token_f1"))


@query(_PAIR.replace("lower(a.text)", "a.text") + r""", g AS (SELECT doc_id, list_transform(range(1, len(x) - 2), lambda i: array_to_string(x[i:i + 3], ' ')) AS g FROM p)
SELECT doc_id, round(CASE WHEN len(g) = 0 THEN 0 ELSE 1 - len(list_distinct(g)) / len(g) END, 6)::DOUBLE AS repeat_rate FROM g""")
def repeat_rate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(U.repeated_share("text")).alias("repeat_rate"))


@query(r"""
WITH s AS (SELECT d.doc_id, regexp_replace(lower(d.text), '^\s+|\s+$', '', 'g') AS p, regexp_replace(lower(b.text), '^\s+|\s+$', '', 'g') AS r
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, contains(p, r) AS exists_match, starts_with(p, r) OR (contains(r, ' ') AND NOT contains(p, ' ') AND starts_with(p, replace(r, ' ', ''))) AS prefix_match, p = r AS exact_match FROM s""")
def match_evaluators(spark, sf_dir):
    """Containment, prefix and equality of whole references, case and outer white space aside."""
    p, r = T.strip(F.lower("text")), T.strip(F.lower("reference"))
    bare = F.replace(r, F.lit(" "), F.lit(""))
    prefix = F.startswith(p, r) | (F.contains(r, F.lit(" ")) & ~F.contains(p, F.lit(" ")) & F.startswith(p, bare))
    return _pairs(spark, sf_dir).select("doc_id", F.contains(p, r).alias("exists_match"), prefix.alias("prefix_match"), (p == r).alias("exact_match"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\[[^\]]*\]|<[^>]*>|\([^)]*\)', '', 'g'), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS normalized FROM documents")
def normalize_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_basic(F.col("text")).alias("normalized"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\S+'), lambda w: w NOT IN ('a', 'an', 'the')), ' ') AS normalized FROM documents")
def normalize_qa(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_qa(F.col("text")).alias("normalized"))


@query(r"""SELECT doc_id, NOT contains(text, ',') AS no_comma, len(regexp_extract_all(text, '\[.*?\]')) >= 1 AS placeholders, length(lower(text)) - length(replace(lower(text), 'e', '')) >= 20 AS letter_e,
  len(regexp_extract_all(text, '(?m)^\s*\*[^\*].*$')) + len(regexp_extract_all(text, '(?m)^\s*-.*$')) = 0 AS no_bullets, NOT regexp_matches(text, '(?i)\b(idiot|moron)\b') AS no_forbidden,
  text = lower(text) AND text <> upper(text) AS lowercase, ends_with(lower(trim(text)), '.') AS ends_with_stop, contains(lower(text), 'the') AND contains(lower(text), 'of') AS keywords FROM documents""")
def ifeval_predicates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", I.no_comma(t).alias("no_comma"), I.number_placeholders(t, 1).alias("placeholders"), I.letter_frequency(t, "e", 20).alias("letter_e"), I.number_bullets(t, 0).alias("no_bullets"), I.forbidden_words(t, ["idiot", "moron"]).alias("no_forbidden"), I.all_lowercase(t).alias("lowercase"), I.end_checker(t, ".").alias("ends_with_stop"), I.keywords_exist(t, ["the", "of"]).alias("keywords"))


_REFUSALS = ", ".join("'" + p.replace("'", "''") + "'" for p in I.REFUSALS)


@query(rf"""
SELECT round(avg(CASE WHEN trim(coalesce(text, '')) = '' OR len(list_filter([{_REFUSALS}], lambda p: contains(lower(text), p))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate, count(*)::BIGINT AS n
FROM conversations WHERE role = 'assistant'""")
def refusal_rate(spark, sf_dir):
    """Refusals by all phrases; a blank answer is one."""
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").agg(r6(F.avg(I.refused(F.col("text")).cast("double"))).alias("refusal_rate"), F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, split_part(html, '<body', 1) AS head, replace(url, 'http', '') AS bare_url, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages")
def post_process(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.force_stop(F.col("html"), "<body").alias("head"), P.eliminate(F.col("url"), "http").alias("bare_url"), T.nz(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, json_extract_string(props, '$.missing') AS missing, coalesce(json_extract_string(props, '$.content'), props) AS content FROM events")
def json_extract(spark, sf_dir):
    p = F.col("props")
    fenced = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(P.extract_json(fenced), "$.k", "string"), F.lit("none")).alias("k"), P.json_extract(p, "missing").alias("missing"), P.content_extract(p).alias("content"))


@query(None)
def first_option(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.first_option(F.col("text"), default="none").alias("option"))


@query(None)
def rouge_l(spark, sf_dir):
    """Longest common subsequence of all the user's and all the assistant's words of a conversation, as F1."""
    w = _sides(table(spark, sf_dir, "conversations"))
    return w.select("conv_id", r6(T.f1(U.lcs_length("r", "h"), F.size("h"), F.size("r"))).alias("rouge_l"))


@query(r"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score, (a.label = b.label)::INT AS same_label FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_verification(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"), F.col("v").alias("u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.try_divide(dot("v", "u"), F.sqrt(dot("v", "v")) * F.sqrt(dot("u", "u")))
    return e.join(n, "vec_id").select("vec_id", r6(score).alias("score"), (F.col("label") == F.col("other")).cast("int").alias("same_label"))


@query("SELECT event_type, k, n FROM (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, json_extract_string(props, '$.k')) AS r FROM events GROUP BY 1, 2) WHERE r <= 10")
def profile_topk(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "k"))).filter("r <= 10").drop("r")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_rates(spark, sf_dir):
    return streams.tumbling(table(spark, sf_dir, "events"))
