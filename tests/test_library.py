"""Goldens and small cases of the library's functions, operators, sources and streams."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from evalspark.functions import evaluation as E
from evalspark.functions import instructions as I
from evalspark.functions import process as P
from evalspark.functions import text as T
from evalspark.functions import text_udf as U
from evalspark.operators import cube, intervals, metrics
from evalspark.plans import queries as plans
from evalspark.sources import events
from evalspark.streaming import events as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_word_error_rate_golden(spark):
    rows = [("the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat"), ("yes", "no")]
    df = spark.createDataFrame(rows, "r string, h string").select(T.words(F.col("r")).alias("r"), T.words(F.col("h")).alias("h"))
    got = df.agg((100 * F.sum(U.edit_distance("r", "h")) / F.sum(F.size("r"))).alias("wer")).first().wer
    assert got == 20.0


def test_edit_distance_of_insertions_and_empties(spark):
    w = lambda s: T.words(F.lit(s))
    assert [value(spark, U.edit_distance(w(a), w(b))) for a, b in (("a b c", "a c"), ("", "x y"), ("", ""), ("naïve", "naive"))] == [1, 2, 0, 1]


def test_classification_and_verification_goldens(spark):
    df = spark.createDataFrame([("a", "a", 0.9, 1), ("a", "b", 0.1, 0)], "p string, r string, s double, y int")
    assert metrics.macro_f1(df, "p", "r").first().macro_f1 == pytest.approx(1 / 3)
    assert metrics.auc(df, "s", "y").first().auc == 1.0
    assert metrics.eer(df, "s", "y").first().eer == 0.0


def test_duration_weighted_rate_and_percentiles(spark):
    df = spark.createDataFrame([(1.0, 1.0, 10.0), (0.0, 9.0, 30.0)], "e double, d double, latency double")
    assert df.agg(metrics.ratio(F.col("e"), F.col("d")).alias("der")).first().der == 0.1
    assert metrics.exact_percentiles(df, [], "latency", (0.5,)).first().latency_p50 == 20.0


def test_cube_leaves_out_missing_keys(spark):
    df = spark.createDataFrame([("x", "u", 1.0), ("x", None, 3.0)], "a string, b string, v double")
    cells = cube.mesh(df, [["a"], ["b"], ["a", "b"]], ["v"]).filter("metric in ('sample_count', 'v', 'small_sample')")
    got = {(r.slice, r.label, r.metric): r.value for r in cells.collect()}
    sizes = {("overall", ""): (2, 2.0), ("a", "x"): (2, 2.0), ("b", "u"): (1, 1.0), ("a+b", "x|u"): (1, 1.0)}
    assert got == {(*k, m): v for k, (n, v1) in sizes.items() for m, v in (("sample_count", n), ("v", v1), ("small_sample", 1))}


def test_text_scores(spark):
    w = lambda s: T.words(F.lit(s))
    assert value(spark, U.repeated_share(F.lit("a b c d a b c d"))) == pytest.approx(0.2)
    assert value(spark, U.common_count(w("a a b"), w("a b b"))) == 2
    assert value(spark, U.lcs_length(w("a b c d"), w("b x d"))) == 2
    assert value(spark, U.lcs_length(w(""), w("b"))) == 0
    assert value(spark, T.normalize_qa(F.lit("The  Cat, sat on a mat!"))) == "cat sat on mat"
    assert value(spark, T.caption(F.lit("A short caption. A second sentence."))) == "A short caption."
    assert [value(spark, T.rating(F.lit(t))) for t in ("4", "Score: [[5]]", "none")] == [4.0, 5.0, None]
    assert [value(spark, T.yes_no(F.lit(t))) for t in ("Yes", "no, incorrect", "?")] == [1, 0, None]


def test_post_processors(spark):
    text = F.lit('Sure:\n```json\n{"city": "Beijing", "days": 2}\n```')
    assert value(spark, F.try_variant_get(P.extract_json(text), "$.days", "int")) == 2
    assert value(spark, P.extract_json(F.lit("no json at all {"))) is None
    assert [value(spark, P.first_option(F.lit(t))) for t in ("The answer is (B).", "C", "D) because", "答案是A", "nothing here")] == ["B", "C", "D", "A", None]
    assert value(spark, F.size(P.tool_calls(F.lit('<tool_call>{"a":1}</tool_call> <tool_call>{"b":2}</tool_call>')))) == 2
    assert [value(spark, E.truth(F.lit(t))) for t in ("false", "允许", "yes", "?")] == [False, True, True, None]
    assert value(spark, P.asr_extract(F.lit("<|en|> hello  world ."))) == "hello world."


def test_instruction_predicates(spark):
    cases = [(I.no_comma(F.lit("a b")), True), (I.number_bullets(F.lit("* a\n- b"), 2), True), (I.title(F.lit("<<T>> x")), True), (I.json_format(F.lit('```json\n{"a": 1}\n```')), True), (I.two_responses(F.lit("a ****** b")), True), (I.quotation(F.lit('"x"')), True), (I.number_paragraphs(F.lit("a *** b"), 2), True), (I.all_capitals(F.lit("ABC")), True), (I.forbidden_words(F.lit("a Bad day"), ["bad"]), False)]
    assert [value(spark, c) for c, _ in cases] == [v for _, v in cases]


def test_interval_operators(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0), (2, 20.0, 21.0)], "id int, start double, end double")
    b = spark.createDataFrame([(7, 5.0, 25.0), (8, 10.0, 11.0)], "id int, start double, end double")
    assert {tuple(r) for r in intervals.overlap_join(a, b, 3.0).collect()} == {(1, 7, 5.0, 10.0), (2, 7, 20.0, 21.0)}
    m = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 2.0), ("s", 5.0, 6.0)], "k string, start double, end double")
    assert {(r.start, r.end, r.n) for r in intervals.gap_merge(m, ["k"], "start", "end", 0.001).collect()} == {(0.0, 2.0, 2), (5.0, 6.0, 1)}


def test_event_log_algebra(spark, tmp_path):
    lines = [{"type": "inference", "id": 0, "data": {"a": 1}}, {"type": "eval", "id": 0, "data": {}}, {"type": "error", "id": 2, "data": {}}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    log = events.read_events(spark, str(tmp_path))
    assert log.filter("event is null").count() == 1
    good = log.filter("event is not null").select("type", "id")
    assert events.merge_shards([good, good.limit(1)])[1].count() == 1
    expected = spark.createDataFrame([("0",), ("1",)], "id string")
    assert {tuple(r) for r in events.completion(good, expected).collect()} == {("1", "missing"), ("2", "unexpected")}


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = streams.read_stream(spark, "/root/testdata/sf0.001", "events.parquet", batch.schema)
    out = streams.run_available(streams.deduplicated(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert out.select("event_id").exceptAll(batch.select("event_id")).count() == 0 and out.count() == batch.count()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(columns)
    plain = lambda v: round(float(v), 6) if not isinstance(v, (bool, str, type(None))) and not hasattr(v, "year") else v
    rows = lambda rs: sorted(repr(tuple(map(plain, r))) for r in rs)
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(got.fetchall())


def test_queries_without_sql_run(spark):
    for name in plans.queries().keys() - plans.oracle_sql().keys():
        assert plans.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
