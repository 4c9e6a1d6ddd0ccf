"""Streams with state: logs folded as they arrive, a cube's statistics merged batch by batch."""

import pytest
from pyspark.sql import functions as F

from evalspark.operators import cube
from evalspark.session import scratch
from evalspark.sources import events as log
from evalspark.streaming import events as streams
from evalspark.streaming import fold, statistics

LOG = "id string, type string, seq long, data string, ts timestamp"


@pytest.fixture()
def feed(spark, tmp_path):
    """Batches of rows as files, and a stream that reads one file a batch."""
    folder = str(tmp_path / "feed")
    for k, v in fold.STORE.items():
        spark.conf.set(k, v)

    def add(rows):
        spark.createDataFrame([(i, t, s, d, m) for i, t, s, d, m in rows], "id string, type string, seq long, data string, minute long").withColumn("ts", F.timestamp_seconds((F.col("minute") + 10**6) * 60)).drop("minute").coalesce(1).write.mode("append").parquet(folder)

    add.folder = folder
    add.stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    return add


def folded(spark, feed, tmp_path):
    run = streams.run_available(fold.fold_stream(feed.stream(), late="1 minute", patience_ms=600_000), str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted((r.id, r.revision, r.closed_by, r.prompt, r.inference, r.eval, r.error) for r in run.collect())


def test_fold_stream_with_a_late_and_a_missing_event(spark, feed, tmp_path):
    feed([("a", "prompt", 1, "p", 0), ("b", "prompt", 2, "q", 1), ("a", "inference", 3, "i", 2)])
    assert folded(spark, feed, tmp_path) == []
    # a's terminal event; its older inference arrives after it
    feed([("a", "eval", 9, "e", 3), ("c", "error", 5, "x", 3)])
    first = folded(spark, feed, tmp_path)
    assert first == [("a", 1, "terminal", "p", "i", "e", None), ("c", 1, "terminal", None, None, None, "x")]
    feed([("a", "inference", 7, "j", 4), ("a", "inference", 2, "old", 4)])
    second = folded(spark, feed, tmp_path)
    assert second == [first[0], ("a", 2, "terminal", "p", "j", "e", None), first[1]]
    # b never ends: event time passes its last event by ten minutes, and what comes later than that is no part of it
    feed([("d", "prompt", 20, "r", 60)])
    folded(spark, feed, tmp_path)
    feed([("d", "eval", 21, "s", 61)])
    third = folded(spark, feed, tmp_path)
    assert [r for r in third if r[0] == "b"] == [("b", 1, "timer", "q", None, None, None)]
    view = fold.folded_view(spark.read.parquet(str(tmp_path / "out")), spark.read.schema(LOG).parquet(feed.folder))
    plain = log.fold(spark.read.schema(LOG).parquet(feed.folder))
    assert sorted(map(tuple, view.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_fold_available_has_every_id_after_each_batch_and_without_one(spark, feed, tmp_path):
    run = lambda: sorted(map(tuple, fold.fold_available(feed.stream(), str(tmp_path / "out"), str(tmp_path / "cp")).collect()))
    feed([("a", "prompt", 1, "p", 0), ("b", "prompt", 2, "q", 1)])
    feed([("a", "eval", 9, "e", 3), ("a", "inference", 7, "j", 4)])
    first = [("a", "p", "j", None, "e", None, None), ("b", "q", None, None, None, None, None)]
    # the second run has nothing to read
    assert run() == first and run() == first
    # older and newer events than those in the state
    feed([("a", "inference", 3, "i", 2), ("b", "prompt", 12, "r", 5), ("c", "other", 13, "x", 5)])
    third = run()
    assert third == [first[0], ("b", "r", *[None] * 5), ("c", *[None] * 6)]
    assert third == sorted(map(tuple, log.fold(spark.read.schema(LOG).parquet(feed.folder)).collect()))


def test_query_stream_fold_calls_no_python_for_ids(spark, monkeypatch):
    from evalspark.plans import queries

    monkeypatch.setattr(fold, "fold_stream", None)
    found, at = queries.queries(), "/root/testdata/sf0.001"
    assert sorted(map(str, found["stream_fold"](spark, at).collect())) == sorted(map(str, found["fold_events"](spark, at).collect()))


def rows_of(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(F.col("event_type").alias("task"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("c"), F.col("user_id") % 3)).alias("capability"), F.col("value").alias("latency_ms"), F.col("value").alias("verification_score"), (F.col("event_id") % 2).alias("verification_label"), (F.col("event_id") % 4 > 0).cast("int").alias("acc"), F.when(F.col("event_id") % 5 == 0, "timeout").alias("failure_type"), F.lit("l").alias("classification_pred"), F.concat(F.lit("l"), F.col("event_id") % 2).alias("classification_ref"))


def cells(df):
    return {(r.slice, r.label, r.metric): pytest.approx(r.value) for r in df.collect()}


def test_batches_merge_to_the_cube_of_all_rows_and_replays_change_nothing(spark):
    rows, sets = rows_of(spark), [["task"], ["capability"], ["task", "capability"]]
    plan = cube.Mesh(rows, sets, ["acc"])
    folder, compacted = scratch(spark, "cube"), scratch(spark, "cube")
    parts = [rows.filter(F.pmod(F.xxhash64("latency_ms"), F.lit(3)) == k) for k in range(3)] + [rows.limit(0)]
    for k, part in enumerate(parts):
        statistics.merge(plan, part, folder, k)
    whole = cells(cube.mesh(rows, sets, ["acc"]))
    got = cells(plan.cells(statistics.maintained(spark, plan, folder)))
    assert got.keys() == whole.keys() and got == whole
    # a batch that is written again after a failure
    statistics.merge(plan, parts[1], folder, 1)
    assert cells(plan.cells(statistics.maintained(spark, plan, folder))) == whole
    statistics.compact(spark, plan, folder, compacted)
    assert cells(plan.cells(statistics.maintained(spark, plan, compacted))) == whole


def test_percentiles_of_ties_infinities_and_near_values(spark):
    import numpy as np

    from evalspark.operators import metrics

    values = [5.0] * 700 + [1e12 + k / 1000 for k in range(200)] + [-3.5, 0.0, 1e-9, 2e-9, float("inf"), float("-inf")] + [k / 7 for k in range(94)]
    df = spark.createDataFrame([(("a", "b")[k % 2], v) for k, v in enumerate(values)] + [("a", None)], "k string, v double")
    for name in "ab":
        mine = [v for k, v in enumerate(values) if "ab"[k % 2] == name]
        got = next(r for r in metrics.exact_percentiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)).collect() if r.k == name)
        with np.errstate(invalid="ignore"):
            expected = [np.quantile(mine, q) for q in (0.25, 0.5, 0.9, 0.95)]
        assert list(got)[2:6] == pytest.approx(expected) and (got[1], got[6]) == (min(mine), max(mine))


def test_overlap_of_slices_and_languages_that_are_missing(spark):
    from evalspark.functions.text_udf import char_gram_counts, word_gram_counts
    from evalspark.operators import overlap

    texts = [("a b c d e", "a b c x e"), ("f g h i", "f g h i j"), ("k l m n o p", "k l m n"), ("q r s t", "q q s t")]
    rows = [(("x", "y")[k % 2], r, h, ("13a", "13a", "13a", "zh")[k], (None, "EN", "de", "en")[k], k, 5) for k, (r, h) in enumerate(texts)]
    df = spark.createDataFrame(rows, "task string, r string, h string, bleu_tokenizer string, language string, wer_errors int, wer_n int")
    split = lambda c: F.split(c, " ")
    df = df.withColumns({"bleu_counts": word_gram_counts(split("h"), split("r")), "chrf_counts": char_gram_counts("h", "r")})
    got = cells(cube.mesh(df, [["task"]], []))
    chrf = {r.task: r.v for r in df.groupBy("task").agg(*overlap.summed("chrf_counts")).select("task", overlap.chrf().alias("v")).collect()}
    bleu = df.filter("task = 'x'").agg(*overlap.summed("bleu_counts")).select(overlap.bleu().alias("v")).first().v
    assert got["task", "x", "bleu"] == pytest.approx(bleu) and ("task", "y", "bleu") not in got and ("overall", "", "bleu") not in got
    assert all(got["task", t, "chrf"] == pytest.approx(v) for t, v in chrf.items())
    # x has a missing language (en) and de, y two ways to write en
    assert ("task", "x", "wer%") not in got and got["task", "y", "wer%"] == 40
