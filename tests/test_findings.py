"""Inputs on which queries once differed from their SQL, and jobs whose memory once grew with their rows."""

import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.functions import spoken_chinese as C
from evalspark.functions import text as T
from evalspark.functions import text_udf as U
from evalspark.operators import adapter
from evalspark.operators import labelling as L
from evalspark.plans import queries as plans


def same_as_sql(spark, folder, name, rows, table):
    """The query's rows over one table of given rows, which must be those of its SQL."""
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = [tuple(r) for r in plans.queries()[name](spark, str(folder)).collect()]
    assert Counter(got) == Counter(con.execute(plans.oracle_sql()[name]).fetchall())
    return got


def test_audio_durations_of_zero_negative_and_missing_values(spark, tmp_path):
    values = [0.0, -1.5, None, 2.25, 0.12345678]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(v for v in values for _ in range(3))], "event_id long, value double")
    same_as_sql(spark, tmp_path, "audio_durations", rows, "events")
    # the operator itself takes positive lengths alone
    audio = F.array(F.struct(F.lit("p").alias("path"), F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), F.lit(0.0).alias("duration")))
    assert spark.range(1).select(L.audio_seconds(F.lit(0.0), audio, F.lit(7.0)).alias("s")).first().s == 2


@pytest.mark.parametrize("n", [0, 9, 29, 30, 50, 60, 70, 71])
def test_audit_sample_of_numbers_that_a_rate_does_not_divide(spark, tmp_path, n):
    got = same_as_sql(spark, tmp_path, "audit_sample", spark.range(n).withColumnRenamed("id", "doc_id"), "documents")
    assert len(got) == min(n, max(1, (n + 10) // 20))
    assert L.share(70, 0.05) == 3 and L.share(300, 0.07) == 21


def test_judge_parsers_on_letters_beyond_ascii(spark, tmp_path):
    texts = ["noño.", "sí, éno", "yes中 no_", "Yes! nó", "none? no1", None, "", "noyes-no\tyes", "ınoİ . NO"]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string")
    same_as_sql(spark, tmp_path, "judge_parsers", rows, "conversations")
    # the operator's words are those of any script
    assert spark.range(1).select(T.yes_no(F.lit("noño")).alias("v")).first().v is None


def test_normalize_chinese_says_each_text_once_and_as_its_parts_do(spark):
    df = plans.queries()["normalize_chinese"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("date_format") == 1
    texts = ["共22000元，占5%。", "3月5日5元6角7分", "1/2和２0%", "a2b 0012 12.5.6% 220000002个", "", None]
    t = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in t.select("t", C.spoken_and_read("t").alias("both"), C.spoken_numerals("t").alias("said"), C.numerals_to_figures(C.spoken_numerals("t")).alias("figures")).collect():
        assert (r.said, r.figures) == tuple(r.both) and (r.t is None) == (r.said is None)
    said = {"22000": "两万两千", "20000000200": "两百亿零二百", "10002": "一万零二", "120000": "十二万", "0012": "零一十二", "2.20": "二点二零"}
    assert {n: C.numeral(n) for n in said} == said
    # units that multiply others, and a last digit behind the unit, stand outside what is put together from parts
    read = {"十十百七六八万一四零": "90000", "三万五": "35000", "五万百": "5000000", "一百八万": "1080000", "两万两千": "22000"}
    assert {n: C.number(n) for n in read} == read


@pytest.mark.parametrize("rows", [0, 1, 3, 500])
def test_batches_are_worked_off_in_slices_and_slices_give_what_wholes_give(monkeypatch, rows):
    texts = [None if k % 7 == 3 else " ".join("abcd"[(j * j + k) % 4] for j in range(k % 50)) for k in range(rows)]
    words = [t and t.split() for t in texts]
    a, b = pa.array(texts, pa.string()), pa.array(texts[::-1], pa.string())
    x, y = pa.array([w or [] for w in words], pa.list_(pa.string())), pa.array([w or [] for w in words[::-1]], pa.list_(pa.string()))
    calls = {"repeated_share": (a,), "common_words": (a, b), "char_gram_counts": (a, b), "lcs_length": (x, y), "edit_distance": (x, y), "common_count": (x, y), "word_gram_counts": (x, y), "best_of": (a, x)}
    whole = {n: getattr(U, n).func(*c) for n, c in calls.items()}
    monkeypatch.setattr(U, "CHUNK_BYTES", 300)
    sizes = [[p.nbytes for p in part] for part in U.chunks(x.slice(0), a)]
    assert sum(map(len, ([p[0] for p in U.chunks(a)]))) == rows and (rows < 500 or len(sizes) > 20) and all(max(s) < 2000 for s in sizes)
    assert {n: getattr(U, n).func(*c).to_pylist() for n, c in calls.items()} == {n: c.to_pylist() for n, c in whole.items()}


def test_a_batch_of_long_texts_takes_little_python_memory():
    texts = pa.array([" ".join(str((j * k) % 997) for j in range(400)) for k in range(6000)])
    lists = pa.array([t.split() for t in texts.to_pylist()[:2000]])
    peaks = []
    for work in (lambda: U.lcs_length.func(lists, lists), lambda: [len(part) for part in U.chunks(texts)]):
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # 800,000 words twice as Python objects are above 90 MB
    assert peaks[0] < 20e6 and peaks[1] < 1e6


def test_errors_of_the_second_schema_read_each_path_once(spark):
    df = plans.queries()["schema_errors_v2"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().analyzed().toString().count("variant_get(") <= 40


def test_records_of_the_first_schema_are_read_once(spark):
    df = plans.queries()["v1_to_v2"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().analyzed().toString().count("variant_get(") <= 40
    record = spark.range(1).select(F.parse_json(F.lit('{"task": "x"}')).alias("r"))
    assert not [c for c in adapter.v1_to_v2(record, "r", {}).columns if c.startswith("_")]
