"""Queries of answer ladders, composed evaluators, summaries and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import ladders
from evalspark.operators import joins
from evalspark.plans.catalog import query
from evalspark.session import scratch, table
from evalspark.sources import events, manifests, reports


def _said(rules: ladders.Rules, text: str) -> str:
    """SQL of a ladder: a CASE over the same rules."""

    def when(phrase: str) -> str:
        p = phrase.replace("'", "''")
        if p.startswith("~"):
            return f"regexp_matches({text}, '{p[1:]}')"
        if p.startswith("^"):
            return f"starts_with({text}, '{p[1:]}')"
        if p.endswith("$") and not p.endswith("}$"):
            return f"ends_with({text}, '{p[:-1]}')"
        return f"contains({text}, '{p}')"

    return "CASE " + " ".join(f"WHEN {when(p)} THEN {a}" for p, a in rules) + " END"


#: Texts of conversations with phrases of answers behind their first words, drawn from the ladder's own rules.
_TALK = r"""
WITH s AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, list_extract(split(coalesce(text, ''), ' '), -1) AS w FROM conversations),
p AS (SELECT *, CASE (conv_id + turn) % 6 WHEN 0 THEN t || ' Hence, the answer is: **Yes**.' WHEN 1 THEN '<2>No. ' || t WHEN 2 THEN t || ' The answer is Ann; she lies' WHEN 3 THEN t || '" tells the truth' WHEN 4 THEN 'You end up back at the starting-point ' || t ELSE t END AS x,
  CASE WHEN turn % 2 = 0 THEN 'web_of_lies' ELSE 'navigate' END || '_' || conv_id AS task, CASE WHEN conv_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS label FROM s),
n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(x), '^<[123]>', ''), '<|turn_end|>', ''), '[:"\-,.：]|\*\*', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM p)"""


@query(_TALK + f""", a AS (SELECT conv_id, turn, role, label, CASE WHEN task LIKE 'web%' THEN {_said(ladders.LIES, "q")} ELSE {_said(ladders.NAVIGATE, "q")} END AS got FROM n)
SELECT conv_id, turn, role, got::INT AS extracted, (got IS NULL)::INT AS extract_fail, coalesce(got = (label = 'Yes')::INT, false)::INT AS match FROM a""")
def answer_ladders(spark, sf_dir):
    """Answers of two puzzles found in conversations, by the first rule of their ladders."""
    c, t = table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit(""))
    k = (F.col("conv_id") + F.col("turn")) % 6
    x = (
        F.when(k == 0, F.concat(t, F.lit(" Hence, the answer is: **Yes**."))).when(k == 1, F.concat(F.lit("<2>No. "), t)).when(k == 2, F.concat(t, F.lit(" The answer is Ann; she lies")))
        .when(k == 3, F.concat(t, F.lit('" tells the truth'))).when(k == 4, F.concat(F.lit("You end up back at the starting-point "), t)).otherwise(t)
    )
    task = F.concat_ws("_", F.when(F.col("turn") % 2 == 0, "web_of_lies").otherwise("navigate"), "conv_id")
    s = ladders.puzzle_scores(x, F.when(F.col("conv_id") % 2 == 0, "Yes").otherwise("no"), task, {"navigate": ladders.NAVIGATE, "web_of_lies": ladders.LIES})
    return c.select("conv_id", "turn", "role", *[v.alias(n) for n, v in s.items()])


@query(r"""
WITH s AS (SELECT d.doc_id, d.lang, b.text AS r, contains(d.text, b.text) AS hit, CASE d.lang WHEN 'en' THEN 'single_round_x' WHEN 'de' THEN 'open' ELSE 'knowledge' END AS subset, l.quality * 5 AS judged
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'open' ELSE 'short' END AS qa_track, CASE WHEN lang IN ('en', 'de') THEN (coalesce(judged, 0) >= 3)::INT ELSE coalesce(hit, false)::INT END AS match,
  CASE WHEN lang IN ('en', 'de') THEN (judged IS NULL)::INT END AS skipped, coalesce(hit, false)::INT AS exact_hit FROM s""")
def split_tracks(spark, sf_dir):
    """Short and open answers scored apart, beside a plain evaluator, as one ensemble."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    items = b.select(F.col("item_id").alias("on"), F.col("text").alias("r"))
    rows = d.withColumn("on", F.col("doc_id") % b.count()).join(items, "on").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hit = F.coalesce(F.contains("text", "r"), F.lit(False)).cast("int")
    subset = F.when(F.col("lang") == "en", "single_round_x").when(F.col("lang") == "de", "open").otherwise("knowledge")
    parts = ladders.ensemble({"match": F.lit(9), "exact_hit": hit}, ladders.split_track(hit, F.col("quality") * 5, subset))
    return rows.select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query(r"""
WITH l AS (SELECT event_id // 3 AS id, event_type AS type, props, value, event_id AS seq FROM events), f AS (SELECT id FROM l GROUP BY id ORDER BY id LIMIT 20)
SELECT id, arg_max(value, seq) FILTER (type = 'click') AS value, left(arg_max(props, seq) FILTER (type = 'view'), 300) AS inference FROM l JOIN f USING (id) GROUP BY id""")
def first_rows(spark, sf_dir):
    """A summary of the first twenty ids, which are the feature."""
    log = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("id"), F.col("event_type").alias("type"), F.struct("props", "value").alias("data"), F.col("event_id").alias("seq"))
    out = events.fold(events.first_ids(log, 20), ("click", "view"))
    return out.select("id", F.col("click.value").alias("value"), F.left(F.col("view.props"), F.lit(300)).alias("inference"))


@query(r"""
WITH i AS (SELECT 'a/' || item_id % 50 || '.wav' AS p, 'b/' || item_id || '.wav' AS q, [text, text || '!'] AS captions, item_id AS line FROM benchmark),
k AS (SELECT p AS path, captions, line FROM i UNION ALL SELECT q, captions, line FROM i), m AS (SELECT path, arg_max(captions, line) AS captions FROM k GROUP BY path)
SELECT doc_id, len(captions)::INT AS n, captions[2] AS second FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a/' || doc_id % 60 ELSE 'b/' || doc_id % 300 END || '.wav' AS path FROM documents) LEFT JOIN m USING (path)""")
def caption_references(spark, sf_dir):
    """Reference captions by audio path, of an index in which a path may stand twice: the later line counts."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("doc_id")
    wav = lambda p, n: F.concat(F.lit(p), n.cast("string"), F.lit(".wav"))
    index = b.select(wav("a/", F.col("item_id") % 50).alias("audio_path"), wav("b/", F.col("item_id")).alias("audio_filepath"), F.array("text", F.concat("text", F.lit("!"))).alias("captions"), F.col("item_id").alias("line"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 0, wav("a/", i % 60)).otherwise(wav("b/", i % 300)).alias("path"))
    out = joins.caption_references(d, index, "path")
    return out.select("doc_id", F.when(F.col("captions").isNotNull(), F.size("captions")).alias("n"), F.get("captions", F.lit(1)).alias("second"))


@query("SELECT lang, array_to_string(list(source ORDER BY source), '|') AS sources, 'n=' || sum(n) AS counts FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def report_csv(spark, sf_dir):
    """A report with lists and maps, written as CSV and read again."""
    d, path = table(spark, sf_dir, "documents"), scratch(spark, "report")
    per = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.create_map(F.lit("n"), F.sum("n")).alias("counts"))
    reports.write_csv(per, path)
    return spark.read.option("header", "true").option("escape", '"').schema("lang string, sources string, counts string").csv(path)


@query(r"""
WITH r AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
SELECT '| p_brand | n |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || p_brand || ' | ' || n || ' |' FROM r""")
def report_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return reports.markdown(rows, ["p_brand", "n"], ["p_brand"])


@query("SELECT o_orderkey, o_orderkey % 10 || '' AS speaker, CASE WHEN o_orderkey % 10 < 7 THEN 'p' || o_orderkey % 10 END AS prompt_text FROM orders")
def prompted_lines(spark, sf_dir):
    """Lines `speaker|text` of orders beside the prompts of their file, of which some lack one."""
    o, at = table(spark, sf_dir, "orders"), scratch(spark, "delimited")
    o.select(F.concat_ws("|", (F.col("o_orderkey") % 10).cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit("|x"))).alias("value")).write.text(f"{at}/lines")
    spark.range(7).select(F.concat(F.col("id").cast("string"), F.lit("|p"), F.col("id").cast("string")).alias("value")).write.text(f"{at}/prompts")
    out = manifests.prompted(spark, f"{at}/lines", f"{at}/prompts")
    key = F.split_part("text", F.lit("|"), F.lit(1)).cast("long")
    return out.select(key.alias("o_orderkey"), "speaker", "prompt_text")
