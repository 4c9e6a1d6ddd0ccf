"""Queries of the slice cube, its coverage and its report, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.text_udf import char_gram_counts, word_gram_counts
from evalspark.operators import cube
from evalspark.operators.error_rates import translation_tokens
from evalspark.plans.catalog import query, r6_all
from evalspark.session import scratch, table
from evalspark.streaming import statistics as streams

#: Score rows made of events: dimensions, metrics and support fields; a seventh has no capability, a fifth no scenario.
_ROWS = r"""
WITH rows AS (
  SELECT event_type AS task, CASE WHEN user_id % 7 > 0 THEN 'c' || user_id % 3 END AS capability, CASE WHEN user_id % 5 > 0 THEN 's' || user_id % 4 ELSE '' END AS scenario__primary,
    CASE WHEN event_id % 4 = 0 THEN 'zh' ELSE 'en' END AS language, CASE WHEN value >= 60 THEN 'formal_subscores' ELSE 'stress_test' END AS use_bucket,
    CASE WHEN event_id % 3 > 0 THEN (value > 20)::INT END AS acc, value AS latency_ms, (event_type = 'error')::INT AS failure, user_id % 11 AS wer_errors, 10 + user_id % 5 AS wer_n,
    'l' || user_id % 3 AS classification_pred, 'l' || event_id % 3 AS classification_ref, CASE WHEN event_id % 10 = 0 THEN 'inference' END AS failure_stage FROM events),
sliced AS (
  SELECT 'overall' AS slice, '' AS label, * FROM rows UNION ALL SELECT 'formal/overall', '', * FROM rows WHERE use_bucket = 'formal_subscores'
  UNION ALL SELECT 'capability', capability, * FROM rows WHERE capability IS NOT NULL
  UNION ALL SELECT 'language', language, * FROM rows
  UNION ALL SELECT 'scenario__primary+capability', scenario__primary || '|' || capability, * FROM rows WHERE capability IS NOT NULL AND scenario__primary <> ''
  UNION ALL SELECT 'task+capability+language', task || '|' || capability || '|' || language, * FROM rows WHERE capability IS NOT NULL),
f1 AS (
  SELECT slice, label, avg(f) AS macro_f1 FROM (
    SELECT slice, label, l, 2.0 * sum(hit) / (sum(p) + sum(r)) AS f FROM (
      SELECT slice, label, classification_pred AS l, 1 AS p, 0 AS r, (classification_pred = classification_ref)::INT AS hit FROM sliced UNION ALL SELECT slice, label, classification_ref, 0, 1, 0 FROM sliced) GROUP BY ALL) GROUP BY ALL),
cells AS (
  SELECT slice, label, unnest([
    {'metric': 'sample_count', 'value': count(*)::DOUBLE}, {'metric': 'small_sample', 'value': CASE WHEN count(*) < 5 THEN 1.0 END::DOUBLE},
    {'metric': 'acc', 'value': avg(acc)}, {'metric': 'acc/sample_count', 'value': nullif(count(acc), 0)::DOUBLE},
    {'metric': 'wer%', 'value': CASE WHEN count(DISTINCT language) = 1 THEN 100.0 * sum(wer_errors) / sum(wer_n) END}, {'metric': 'wer%/sample_count', 'value': CASE WHEN count(DISTINCT language) = 1 THEN count(wer_n) END::DOUBLE},
    {'metric': 'failure_rate', 'value': avg(failure)}, {'metric': 'failure_rate/sample_count', 'value': count(failure)::DOUBLE},
    {'metric': 'latency_p50', 'value': quantile_cont(latency_ms, 0.5)}, {'metric': 'latency_p90', 'value': quantile_cont(latency_ms, 0.9)}, {'metric': 'latency_p95', 'value': quantile_cont(latency_ms, 0.95)},
    {'metric': 'failure_stage/inference/count', 'value': nullif(count(failure_stage), 0)::DOUBLE}]) AS m FROM sliced GROUP BY slice, label
  UNION ALL SELECT slice, label, {'metric': 'macro_f1', 'value': macro_f1} FROM f1)"""
_SETS = [["capability"], ["language"], ["scenario__primary", "capability"], ["task", "capability", "language"], ["no_such_column"]]


def score_rows(spark, sf_dir):
    return _scored(table(spark, sf_dir, "events"))


def _scored(e):
    u = F.col("user_id")
    name = lambda p, c: F.concat(F.lit(p), c)
    return e.select(
        F.col("event_type").alias("task"), F.when(u % 7 > 0, name("c", u % 3)).alias("capability"), F.when(u % 5 > 0, name("s", u % 4)).otherwise("").alias("scenario__primary"),
        F.when(F.col("event_id") % 4 == 0, "zh").otherwise("en").alias("language"), F.when(F.col("value") >= 60, "formal_subscores").otherwise("stress_test").alias("use_bucket"),
        F.when(F.col("event_id") % 3 > 0, (F.col("value") > 20).cast("int")).alias("acc"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").cast("int").alias("failure"),
        (u % 11).alias("wer_errors"), (10 + u % 5).alias("wer_n"), name("l", u % 3).alias("classification_pred"), name("l", F.col("event_id") % 3).alias("classification_ref"),
        F.when(F.col("event_id") % 10 == 0, "inference").alias("failure_stage"), F.lit("acc|wer").alias("metric_names"),
    )


@query(_ROWS + " SELECT slice, label, m.metric AS metric, round(m.value, 6) AS value FROM cells WHERE m.value IS NOT NULL")
def mesh_cube(spark, sf_dir):
    return r6_all(cube.mesh(score_rows(spark, sf_dir), _SETS), "value")


@query(_ROWS + " SELECT slice, label, m.metric AS metric, round(m.value, 6) AS value FROM cells WHERE m.value IS NOT NULL")
def stream_cube(spark, sf_dir):
    """The same cells from a table that each of four micro-batches merges into."""
    source, folder = scratch(spark, "cube-source"), scratch(spark, "cube-table")
    events = table(spark, sf_dir, "events")
    events.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    plan = cube.Mesh(score_rows(spark, sf_dir), _SETS)
    streams.maintain(plan, _scored(stream), folder, scratch(spark, "cube-checkpoint"))
    return r6_all(plan.cells(streams.maintained(spark, plan, folder)), "value")


#: A run's log as data: the columns of the score rows, whose failures the events of type error stand for.
_DATA = "task string, capability string, scenario__primary string, language string, use_bucket string, acc int, latency_ms double, wer_errors long, wer_n long, classification_pred string, classification_ref string, failure_stage string, metric_names string, failure int"


@query(_ROWS.replace("(event_type = 'error')::INT AS failure", "(event_type = 'error')::INT AS failure, (event_type = 'error')::INT * 0 AS timeout") + r""" SELECT CASE slice WHEN 'capability' THEN 'by_capability/' || label WHEN 'scenario__primary+capability' THEN 'by_scenario/' || split_part(label, '|', 1) || '/by_capability/' || split_part(label, '|', 2) ELSE slice END AS path,
  replace(m.metric, '/', '__') AS metric, round(m.value, 6) AS value FROM cells WHERE m.value IS NOT NULL AND slice IN ('overall', 'formal/overall', 'capability', 'scenario__primary+capability')""")
def suite_report(spark, sf_dir):
    """Runs in several folders, found, scored, cut and put in a tree; prompts and answers in the logs don't count."""
    at, rows = scratch(spark, "suite"), score_rows(spark, sf_dir)
    kind = F.when(F.col("failure") == 1, "error").otherwise("eval")
    data = F.struct(*[c for c in rows.columns if c != "failure"], F.when(F.col("failure") == 0, 0).alias("failure"))
    line = lambda kind, data: F.to_json(F.struct(kind.alias("type"), F.lit("1").alias("id"), data.alias("data"))).alias("value")
    for run in ("click", "other"):
        mine = rows.filter((F.col("task") == "click") == (run == "click"))
        # Spark's own names end in .txt here
        mine.select(F.explode(F.array(line(F.lit("prompt"), F.struct("task")), line(kind, data)))).write.text(f"{at}/{run}")
    found = cube.suite_report(spark, at, _DATA, _SETS, glob="*.txt")
    # a log's events say nothing of timeouts, and an error isn't one
    return r6_all(found.filter("metric not like 'timeout%'"), "value")


@query(_ROWS + r""", worse AS (SELECT slice, label, acc + (latency_ms > 50)::INT AS acc FROM sliced),
a AS (SELECT slice, label, avg(acc) AS v FROM sliced GROUP BY ALL), b AS (SELECT slice, label, avg(acc) AS v FROM worse GROUP BY ALL)
SELECT slice, label, 'acc' AS metric, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta FROM a JOIN b USING (slice, label) WHERE abs(a.v - b.v) > 0.001""")
def rescore_diff(spark, sf_dir):
    """Rows scored again by another rule, their cells beside those of the first scores."""
    rows = score_rows(spark, sf_dir)
    again = rows.withColumn("acc", F.col("acc") + (F.col("latency_ms") > 50).cast("int"))
    cells = lambda df: cube.mesh(df, _SETS).filter("metric = 'acc'")
    return r6_all(cube.difference(cells(rows), cells(again), 0.001), "before", "after", "delta")


@query(None)
def overlap_cube(spark, sf_dir):
    """BLEU and chrF of slices, from summed n-gram counts: user turns against the turns after them, by role of those."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumns({"heard": F.lead("text").over(w), "language": F.lead("role").over(w)}).filter("heard is not null")
    low = lambda x: translation_tokens(F.lower(x))
    rows = c.select(F.col("role").alias("task"), F.col("language").alias("capability"), word_gram_counts(low("heard"), low("text")).alias("bleu_counts"), char_gram_counts("heard", "text").alias("chrf_counts"), F.when(F.col("conv_id") % 9 == 0, "zh").otherwise("13a").alias("bleu_tokenizer"))
    return r6_all(cube.mesh(rows, [["task"], ["task", "capability"]], []), "value")


@query(_ROWS + r""" SELECT CASE slice WHEN 'capability' THEN 'by_capability/' || label WHEN 'scenario__primary+capability' THEN 'by_scenario/' || split_part(label, '|', 1) || '/by_capability/' || split_part(label, '|', 2) ELSE slice END AS path,
  replace(m.metric, '/', '__') AS metric, round(m.value, 6) AS value FROM cells WHERE m.value IS NOT NULL AND slice IN ('overall', 'formal/overall', 'capability', 'scenario__primary+capability')""")
def nested_report(spark, sf_dir):
    return r6_all(cube.nested_report(cube.mesh(score_rows(spark, sf_dir), _SETS)), "value")


@query(_ROWS.split("sliced AS")[0].rstrip().rstrip(",") + r""",
f AS (SELECT 'capability' AS field, capability IS NOT NULL AS known, task AS source FROM rows UNION ALL SELECT 'scenario__primary', scenario__primary <> '', NULL FROM rows)
SELECT field, unnest(['known_count', 'missing_or_unknown_count', 'known_rate']) AS metric, unnest([count(*) FILTER (known), count(*) FILTER (NOT known), round(avg(known::INT), 6)])::DOUBLE AS value FROM f GROUP BY field
UNION ALL SELECT field, 'source/' || source || '/count', count(*)::DOUBLE FROM f WHERE known AND source IS NOT NULL GROUP BY ALL""")
def metric_coverage(spark, sf_dir):
    return r6_all(cube.coverage(score_rows(spark, sf_dir), ["capability", "scenario__primary"], {"capability": "task"}), "value")


@query(_ROWS.split("sliced AS")[0].rstrip().rstrip(",") + r""", s AS (SELECT latency_ms AS v, failure AS y FROM rows), per AS (SELECT v, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY v),
c AS (SELECT *, sum(n) OVER (ORDER BY v) - n AS below, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM per)
SELECT 'overall' AS slice, '' AS label, 'auc' AS metric, round(sum(p * (below + n / 2.0)) / max(np * nn), 6) AS value FROM c""")
def verification_cube(spark, sf_dir):
    rows = score_rows(spark, sf_dir).select(F.col("latency_ms").alias("verification_score"), F.col("failure").alias("verification_label"))
    return r6_all(cube.mesh(rows, [], []).filter("metric = 'auc'"), "value")
