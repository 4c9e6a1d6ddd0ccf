"""Queries of manifests, schemas, file positions and samples, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text_udf import best_of
from evalspark.operators import adapter, intervals, ordering, schemas
from evalspark.plans.catalog import query
from evalspark.session import scratch, table
from evalspark.sources import events, manifests

TAXONOMY = {
    "tasks": ["asr", "qa"], "capabilities": {"asr": ["transcription"], "qa": ["answering"]}, "scenarios": ["en", "de", "fr"], "splits": ["test", "validation"], "split_aliases": {"dev": "validation"},
    "use_buckets": ["diagnostic_evidence", "formal_subscores"], "metrics": ["wer", "acc"], "metric_aliases": {"word_error_rate": "wer"}, "default_metrics": {"answering": ["acc"]},
    "conditions": {"acoustic": ["noisy", "clean"], "device": ["phone"]}, "required_conditions": {"default": ["device"]}, "required_reference": {"answering": ["label"]},
}


def manifest_lines(spark, sf_dir):
    """Records of the documents, in the several shapes that manifests have."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    some = lambda c, v: F.when(c, v)
    record = F.struct(
        some(i % 7 > 0, i.cast("string")).alias("sample_id"), F.col("source").alias("dataset"), some(i % 3 == 0, F.lit("task:asr")).alias("task"),
        F.struct(some(i % 3 == 1, F.array(F.lit("t:asr"), F.lit("t:other"))).alias("task_tags"), F.lit("c:transcription").alias("capability_tags")).alias("tags"), some(F.col("lang") != "en", F.lit("answering")).alias("capability"),
        F.concat(F.lit("s:"), "lang").alias("scenario"), some(i % 2 == 0, F.lit("x:Word_Error_Rate, cer|wer")).alias("metrics"), some(i % 4 == 0, F.lit("formal_subscores")).alias("use_bucket"),
        F.struct(F.col("lang").alias("language"), some(F.col("n_chars") > 500, F.array(F.lit("noisy"), F.lit("odd"))).alias("acoustic"), some(i % 8 == 0, F.lit("phone")).alias("device")).alias("metadata"),
        F.struct(some(i % 2 == 1, F.lit("Dev")).alias("original_split")).alias("source"), some(i % 2 == 0, F.lit("test")).alias("split"), F.struct(F.col("text").alias("text"), (i % 2 == 0).alias("label")).alias("reference"),
        some(i % 5 > 0, F.concat(F.lit("${ROOT:-audio}/"), i.cast("string"), F.lit(".wav"))).alias("WavPath"),
    )
    return d.select(F.to_json(record).alias("value"))


_MANIFEST = r"""
WITH r AS (
  SELECT doc_id AS i, source, lang, coalesce(text, '') AS reference_text, n_chars, CASE WHEN doc_id % 3 < 2 THEN 'asr' ELSE 'qa' END AS task, CASE WHEN lang <> 'en' THEN 'answering' ELSE 'transcription' END AS capability,
    CASE WHEN doc_id % 4 = 0 THEN 'formal_subscores' ELSE 'diagnostic_evidence' END AS use_bucket, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'validation' END AS split FROM documents),
m AS (SELECT *, CASE WHEN i % 2 = 0 THEN ['wer', 'cer'] WHEN capability = 'answering' THEN ['acc'] ELSE [] END AS metrics FROM r),
e AS (
  SELECT *, list_filter([
    CASE WHEN source IS NULL THEN 'missing required field: dataset_id' END, CASE WHEN n_chars <= 500 AND i % 8 > 0 THEN 'missing required field: condition' END, CASE WHEN len(metrics) = 0 THEN 'missing required field: metrics' END,
    CASE WHEN i % 2 = 0 THEN 'unknown metric: cer' END, CASE WHEN (task = 'asr') <> (capability = 'transcription') THEN 'capability ' || capability || ' does not belong to task ' || task END,
    CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown scenario: ' || lang END, CASE WHEN n_chars > 500 THEN 'unknown condition acoustic: odd' END,
    CASE WHEN use_bucket = 'formal_subscores' AND i % 8 > 0 THEN 'missing required condition for ' || capability || ': device' END,
    CASE WHEN i % 5 = 0 THEN 'missing audio input' END], lambda x: x IS NOT NULL) AS errors FROM m)"""


@query(_MANIFEST + r""" SELECT coalesce(CASE WHEN i % 7 > 0 THEN i::VARCHAR END, coalesce(source, 'sample') || '-unknown') AS sample_id, source AS dataset_id, task, capability, lang AS scenario, lang AS language, use_bucket, split,
  CASE WHEN i % 2 = 1 THEN 'Dev' END AS source_split, 'classification' AS answer_type, reference_text, array_to_string(metrics, ',') AS metrics, CASE WHEN i % 5 > 0 THEN 'audio/' || i || '.wav' ELSE '' END AS audio,
  CASE WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS schema_errors FROM e""")
def unified_scan(spark, sf_dir):
    """The documents' manifest, written and scanned: one schema out of several shapes, and what is wrong with each record."""
    path = scratch(spark, "manifest")
    manifest_lines(spark, sf_dir).write.text(path)
    out = schemas.unified_scan(spark, path, TAXONOMY, default_task="qa")
    audio = F.regexp_replace("audio", r"^.*/(audio/[^/]*)$", "$1").alias("audio")
    plain = [c for c in ("sample_id", "dataset_id", "task", "capability", "scenario", "language", "use_bucket", "split", "source_split", "answer_type", "reference_text")]
    return out.select(*plain, F.array_join("metrics", ",").alias("metrics"), audio, F.array_join("schema_errors", "; ").alias("schema_errors"))


@query(_MANIFEST + " SELECT x AS error, count(*)::BIGINT AS n FROM (SELECT unnest(errors) AS x FROM e) GROUP BY x")
def schema_errors(spark, sf_dir):
    """How often each fault occurs."""
    lines = manifest_lines(spark, sf_dir).select(F.parse_json("value").alias("record"))
    rows = schemas.normalized(lines, "record", TAXONOMY, "qa")
    return rows.select(F.explode(schemas.errors("record", TAXONOMY)).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


V2_TAXONOMY = {"tasks": {"click": ["c1", "c2"], "view": ["c0"]}, "primary": ["p0", "p1"], "secondary": {"p0": ["s0"]}, "enums": {"weather": ["sun", "rain"]}, "core_fields": ["device"]}


@query(r"""
WITH r AS (SELECT event_id, event_type AS task, 'c' || user_id % 3 AS capability, 'p' || user_id % 3 AS p, CASE WHEN event_id % 4 = 0 THEN 's0' END AS s, event_id % 5 AS w, event_id % 6 AS d, event_id % 2 = 0 AS formal FROM events)
SELECT event_id, array_to_string(list_filter([
  CASE WHEN d = 3 THEN 'missing required V2 field: split' END,
  CASE WHEN task NOT IN ('click', 'view') THEN 'unknown V2 task: ' || task END,
  CASE WHEN task = 'click' AND capability = 'c0' OR task = 'view' AND capability <> 'c0' THEN 'capability ' || capability || ' does not belong to V2 task ' || task END,
  CASE WHEN w = 4 THEN 'V2 scenario must be an object' END,
  CASE WHEN w <> 4 AND p = 'p2' THEN 'unknown V2 scenario.primary: p2' END,
  CASE WHEN w <> 4 AND s IS NOT NULL AND p <> 'p0' THEN 'scenario.secondary s0 does not belong to ' || p END,
  CASE WHEN w = 2 THEN 'unknown metadata.weather: fog' END,
  CASE WHEN d = 1 THEN 'metadata.speaker_count must be a non-negative integer or null' END,
  CASE WHEN formal AND d = 2 THEN 'formal V2 sample has unknown core metadata: device' END], lambda x: x IS NOT NULL), '; ') AS errors FROM r""")
def schema_errors_v2(spark, sf_dir):
    """Faults of records of the second schema, made of events."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    scenario = F.when(i % 5 == 4, F.lit('"vehicle"')).otherwise(F.to_json(F.struct(F.concat(F.lit("p"), u % 3).alias("primary"), F.when(i % 4 == 0, "s0").alias("secondary"))))
    weather = F.when(i % 5 == 2, F.lit('["sun", "fog"]')).otherwise(F.lit('"rain"'))
    text = F.concat(
        F.lit('{"schema_version": "2.0", "sample_id": 1, "dataset": "d", "capability_protocol": "x", "input": {"a": 1}, "reference": {"a": 1}, "provenance": {"a": 1}, "task": "'), "event_type", F.lit('", "capability": "c'), (u % 3).cast("string"),
        F.lit('", "scenario": '), scenario, F.lit(', "metadata": {"weather": '), weather, F.lit(', "speaker_count": '), F.when(i % 6 == 1, "-1").otherwise("2"), F.lit(', "device": "'), F.when(i % 6 == 2, "unknown").otherwise("phone"),
        F.lit('"}, "use_bucket": "'), F.when(i % 2 == 0, "formal_subscores").otherwise("stress_test"), F.lit('"'), F.when(i % 6 == 3, "").otherwise(', "split": "test"'), F.lit("}"),
    )
    return e.select("event_id", F.array_join(schemas.v2_errors(F.parse_json(text), V2_TAXONOMY), "; ").alias("errors"))


@query("SELECT c.conv_id, c.turn, c.role, c.text AS said, md5(coalesce(c.text, '')) AS recorded FROM conversations c")
def positional_attach(spark, sf_dir):
    """Two files of one length, written in one order: what was recorded for a line stands at the same line of the other."""
    rows = table(spark, sf_dir, "conversations")
    order, at = ["conv_id", "turn", "role", "text"], scratch(spark, "positional")
    placed = ordering.written(rows.repartitionByRange(4, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text"), "ordered")
    # one task writes one file; the same scan writes both, file by file
    by_file = placed.withColumn("part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    by_file.select("part", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.partitionBy("part").text(f"{at}/samples")
    by_file.select("part", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("value")).write.partitionBy("part").text(f"{at}/recorded")
    name = lambda df: df.withColumn("part", F.regexp_extract("file", "part=([^/]*)", 1)).drop("file")
    samples = name(ordering.lines(spark, f"{at}/samples"))
    recorded = name(ordering.lines(spark, f"{at}/recorded")).withColumnRenamed("value", "recorded")
    both = ordering.attach_by_position(samples, recorded, ["part"])
    return both.select(F.from_json("value", "conv_id long, turn long, role string, text string").alias("s"), "recorded").select("s.conv_id", "s.turn", "s.role", F.col("s.text").alias("said"), "recorded")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id || ':7'), doc_id) AS k FROM documents) WHERE k <= 150")
def random_sample(spark, sf_dir):
    """A sampling operator: exactly 150 documents, the same ones in every run; fewer rows than that are an error."""
    return ordering.exact_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 150, 7, strict=True)


@query("SELECT page_id, url, sha256(coalesce(html, '') || chr(10)) AS sha256, (octet_length(encode(coalesce(html, ''))) + 1)::BIGINT AS size_bytes FROM pages")
def prepared_assets(spark, sf_dir):
    """Pages as assets of a prepared dataset: files, their inventory with sizes and digests, checked when it is read."""
    at = scratch(spark, "assets")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("asset"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("html"))
    manifests.write_assets(pages.select("asset", F.col("html").cast("binary").alias("content")), f"{at}/files")
    manifests.prepare(pages.select("page_id", "url", "asset"), at, "asset", f"{at}/files")
    read = manifests.read_with_assets(spark, at, "page_id long, url string, asset string", "asset")
    return read.select("page_id", "url", "sha256", "size_bytes")


V2_TASKS = {"spoken_agentic_interaction": ["tool_call"]}


@query(r"""
WITH r AS (
  SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'speaker' WHEN 2 THEN 'agent' WHEN 3 THEN 'speech_output' WHEN 4 THEN 'runtime' ELSE event_type END AS t, CASE event_id % 6 WHEN 0 THEN 'asr' WHEN 2 THEN 'qa' WHEN 5 THEN 'odd' ELSE 'paralinguistic' END AS c,
    CASE user_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'overlap_speech' WHEN 2 THEN 'hum' END AS acoustic, CASE WHEN event_id % 5 = 0 THEN 'near_field' WHEN event_id % 5 = 1 THEN 'roof' END AS spatial,
    CASE event_id % 7 WHEN 0 THEN 'phone' WHEN 1 THEN 'home' WHEN 2 THEN 'space' END AS s, event_id % 3 = 0 AS formal, event_id % 2 = 0 AS full_ FROM events),
m AS (SELECT *, CASE WHEN t = 'runtime' AND c <> 'asr' THEN CASE c WHEN 'x' THEN 'y' END WHEN c = 'asr' THEN 'speech_recognition_transcription' WHEN c IN ('qa', 'paralinguistic') THEN 'audio_speech_understanding' END AS task,
  CASE WHEN s = 'home' THEN 'home' ELSE 'unknown' END AS p, coalesce(CASE WHEN full_ THEN 'car' END, CASE WHEN s = 'phone' THEN 'phone' END, 'unknown') AS device,
  coalesce(CASE WHEN full_ THEN 'wind' END, CASE acoustic WHEN 'clean' THEN 'clean' WHEN 'overlap_speech' THEN 'speech' END, 'unknown') AS noise FROM r)
SELECT i AS event_id, task, CASE WHEN task IS NOT NULL THEN CASE c WHEN 'paralinguistic' THEN 'paralinguistic_recognition' ELSE c END END AS capability, p AS primary_, device, noise,
  CASE WHEN formal THEN CASE WHEN p = 'unknown' OR NOT full_ OR spatial IS DISTINCT FROM 'near_field' OR acoustic IS DISTINCT FROM 'overlap_speech' THEN 'coverage_debt' ELSE 'formal_subscores' END ELSE 'diagnostic_evidence' END AS use_bucket,
  CASE WHEN acoustic = 'clean' OR acoustic = 'overlap_speech' THEN 'human' WHEN NOT full_ THEN 'unknown' END AS noise_source,
  array_to_string(list_filter([CASE WHEN spatial = 'roof' THEN 'legacy spatial value retained only in legacy: roof' END, CASE WHEN acoustic = 'hum' THEN 'ambiguous legacy acoustic value retained: hum' END,
    CASE WHEN s = 'phone' THEN 'legacy scenario=phone migrated to metadata.device_type; scenario left unknown' WHEN s IS DISTINCT FROM 'home' THEN 'scenario has no supported evidence and remains unknown' END,
    CASE WHEN formal AND (p = 'unknown' OR NOT full_ OR spatial IS DISTINCT FROM 'near_field' OR acoustic IS DISTINCT FROM 'overlap_speech') THEN 'formal_subscores downgraded to coverage_debt because V2 attributes are unknown' END], lambda x: x IS NOT NULL), '; ') AS warnings,
  CASE WHEN task IS NULL THEN CASE WHEN t = 'runtime' THEN 'legacy runtime Task is a measurement family and has no canonical V2 Task' ELSE 'cannot map legacy task/capability without evidence: ' || t || '/' || c END END AS error FROM m""")
def v1_to_v2(spark, sf_dir):
    """Records of the first schema, made of events, as records of the second."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    pick = lambda k, *values: F.element_at(F.array(*[F.lit(v) if not hasattr(v, "alias") else v for v in values]), (k + 1).cast("int"))
    none = F.lit(None).cast("string")
    full = i % 2 == 0
    record = F.struct(
        pick(i % 6, "x", "speaker", "agent", "speech_output", "runtime", F.col("event_type")).alias("task"), pick(i % 6, "asr", "paralinguistic", "qa", "paralinguistic", "paralinguistic", "odd").alias("capability"),
        F.struct(pick(u % 4, "clean", "overlap_speech", "hum", none).alias("acoustic"), pick(i % 5, "near_field", "roof", none, none, none).alias("spatial"), F.lit("single_speaker").alias("speaker")).alias("condition"),
        pick(i % 7, "phone", "home", "space", none, none, none, none).alias("scenario"), F.when(i % 3 == 0, "formal_subscores").alias("use_bucket"),
        F.when(full, F.struct(F.lit("car").alias("device_type"), F.lit("wind").alias("noise_type"), F.lit("high").alias("snr_bucket"))).alias("metadata"), F.struct(F.create_map(F.lit("condition.acoustic"), F.lit("Human")).alias("sources")).alias("label_meta"),
    )
    out = adapter.v1_to_v2(e.select("event_id", F.parse_json(F.to_json(record)).alias("record")), "record", V2_TASKS)
    return out.select("event_id", "task", "capability", F.col("primary").alias("primary_"), F.col("metadata")["device_type"].alias("device"), F.col("metadata")["noise_type"].alias("noise"), "use_bucket", F.col("provenance")["noise_type"]["source"].alias("noise_source"), F.array_join("warnings", "; ").alias("warnings"), "error")


@query("SELECT o_orderkey, o_totalprice AS price FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k % (n // 40) = 0 AND k // (n // 40) < 40")
def stride_sample(spark, sf_dir):
    """A sampling operator: 40 rows at even distances in order of price."""
    return ordering.stride_sample(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), ["price", "o_orderkey"], 40)


@query(r"""
WITH s AS (SELECT user_id % 20 AS meeting, 'e' || (user_id % 3) AS speaker, epoch(ts) % 600 AS a, epoch(ts) % 600 + 1 + event_id % 4 AS b FROM events),
w AS (SELECT meeting, unnest(generate_series(0, greatest(floor(((SELECT max(b) FROM s x WHERE x.meeting = m.meeting) + 0.000001 - 30) / 20), -1)::INT)) * 20.0::DOUBLE AS t FROM (SELECT DISTINCT meeting FROM s) m),
c AS (SELECT w.meeting, w.t, speaker, sum(least(b, t + 30) - greatest(a, t)) AS speech FROM w JOIN s ON s.meeting = w.meeting AND s.a < w.t + 30 AND s.b > w.t GROUP BY ALL)
SELECT meeting::BIGINT AS meeting, t AS window_start, count(*)::BIGINT AS speakers, round(sum(speech), 3) AS speech FROM c GROUP BY meeting, t HAVING count(*) >= 2 AND sum(speech) >= 4""")
def speech_windows(spark, sf_dir):
    """Windows of meetings with at least two speakers and four seconds of speech, each segment clipped to the window."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 600
    s = e.select((F.col("user_id") % 20).alias("meeting"), F.concat(F.lit("e"), F.col("user_id") % 3).alias("speaker"), at.alias("start"), (at + 1 + F.col("event_id") % 4).alias("end"))
    w = intervals.speech_windows(s, ["meeting"])
    return w.select("meeting", "window_start", "speakers", F.round("speech", 3).alias("speech"))


@query(r"""
WITH l AS (SELECT event_id // 3 AS id, CASE event_type WHEN 'signup' THEN 'eval' WHEN 'error' THEN 'error' WHEN 'click' THEN 'skipped' ELSE 'inference' END AS type FROM events),
per AS (SELECT id, bool_or(type = 'error') AS failed, bool_or(type = 'skipped') AND NOT bool_or(type = 'error') AS skipped FROM l GROUP BY id)
SELECT count(*)::BIGINT AS n, count(*) FILTER (failed)::BIGINT AS failed, count(*) FILTER (skipped)::BIGINT AS skipped_count, round(count(*) FILTER (failed) / count(*), 6) AS failure_rate, round(100.0 * count(*) FILTER (failed) / count(*), 6) AS "fail_rate(%d)", round(count(*) FILTER (skipped) / count(*), 6) AS skip_rate FROM per""")
def run_summary(spark, sf_dir):
    """A run's rates over all its samples, whatever became of them."""
    t = F.col("event_type")
    kind = F.when(t == "signup", "eval").when(t == "error", "error").when(t == "click", "skipped").otherwise("inference")
    log = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("id"), kind.alias("type"))
    out = events.run_summary(log.select("id").distinct(), log)
    return out.select("n", "failed", "skipped_count", *[F.round(c, 6).alias(c) for c in ("failure_rate", "fail_rate(%d)", "skip_rate")])


@query(r"""
WITH c AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT conv_id, role, regexp_extract_all(regexp_replace(lower(t), '[\p{P}!-/:-@\[-`{-~]', ' ', 'g'), '\S+') AS w FROM c),
p AS (SELECT a.conv_id, a.w AS x, b.w AS y, b.role FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role <> 'user'),
n AS (SELECT conv_id, role, len(x) AS nx, len(y) AS ny, x = y AS em, coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))), 0) AS k FROM p)
SELECT conv_id, round(max(CASE WHEN nx = 0 AND ny = 0 THEN 1.0 WHEN nx = 0 OR ny = 0 THEN 0 ELSE 2.0 * k / (nx + ny) END), 6)::DOUBLE AS text_f1, max(em::INT) AS exact_match FROM n GROUP BY conv_id""")
def best_text_f1(spark, sf_dir):
    """The user's words against each other role's, the best of these references."""
    c = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("t"))
    refs = F.collect_list(F.when(F.col("role") != "user", F.col("t")))
    both = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("t"))).alias("p"), refs.alias("refs")).filter("p is not null and size(refs) > 0")
    s = both.select("conv_id", best_of("p", "refs").alias("s"))
    return s.select("conv_id", F.round("s.text_f1", 6).alias("text_f1"), F.col("s.exact_match").cast("int").alias("exact_match"))
