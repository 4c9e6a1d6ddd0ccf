"""The queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import chat, embedding_dedup, filter_audit, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, token_counts, token_output, toxicity, whitening
from evalspark.llm.shared import work_dir

#: A conversation whose texts are the template's own control strings.
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = turns.unionByName(probe)
    return chat.read_back(chat.format_paths(chat.best_paths(chat.thread_links(turns)), chat.thread_messages(turns)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_orc_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-ids")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_output.digests(token_output.read_tokens(spark, path))


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = lambda c: language_id.held_out(c, 5, 0)
    model = toxicity.fit(docs.filter(~held(docs.doc_id)), labels.filter(~held(labels.doc_id)))
    return toxicity.score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = quality_rules.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return assessed.select("doc_id", *(F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = lambda c: language_id.held_out(c, 4, 2)
    model = language_id.fit(docs.filter(~held(docs.doc_id)))
    return language_id.predict(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chat_formatting, op2_line_dedup, op3_ngram_jaccard_join, op4_token_orc_output, op5_toxicity_grammar, op6_quality_rules, op7_embedding_near_dedup, op8_packing, op9_language_id, op10_source_mixing, op11_filter_audit, op12_token_counts, op13_embedding_whitening)
    return {f.__name__: f for f in every}


_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[TEXT\]|\[/ROLE\]')) AS n_chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n_chars + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length(role) + 23 END) + count(*) - 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""

_OP2 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
solid AS (
  SELECT doc_id, place, trim(line, {_BLANKS}) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k
  FROM lines WHERE trim(line, {_BLANKS}) <> ''),
win AS (
  SELECT * FROM (SELECT doc_id, k, t AS t1, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE t3 IS NOT NULL),
later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, k) AS n FROM win) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) AS o(d)),
gone AS (SELECT s.doc_id, s.place FROM solid s JOIN covered c ON c.doc_id = s.doc_id AND c.k = s.k),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS kept_text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place
  WHERE g.place IS NULL GROUP BY l.doc_id),
state AS (
  SELECT s.doc_id, count(*) AS n_solid, count(g.place) AS n_gone FROM solid s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.place = s.place GROUP BY s.doc_id)
SELECT d.doc_id,
  CASE WHEN coalesce(n_gone, 0) = 0 THEN d.text WHEN n_gone = n_solid THEN '' ELSE coalesce(kept_text, '') END AS text,
  d.lang, d.source,
  CASE WHEN coalesce(n_gone, 0) = 0 THEN d.n_chars WHEN n_gone = n_solid THEN 0 ELSE length(coalesce(kept_text, '')) END::BIGINT AS n_chars
FROM documents d LEFT JOIN state s USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_OP3 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sizes
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
_OP6 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM t WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: w IN ({_STOPS}))) AS n_stop,
    len(list_filter(words, lambda w: length(w) > 1 AND regexp_matches(w, '{quality_rules.ALL_CAPITALS}'))) AS n_capital,
    len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_dots
  FROM t LEFT JOIN repeated r ON r.doc_id = t.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.10 AND n_stop >= 2 AND n_capital / n_words <= 0.70
    AND (n_dup_lines < 3 OR n_dup_lines / n_lines <= 0.30) AND n_bullets / n_lines <= 0.90 AND n_dots / n_lines <= 0.30 AND n_repeat_words / n_words <= 0.50 AS kept
FROM m"""


def mixing_sql(documents: str = "documents") -> str:
    """CTEs that end in `taken` (doc_id, size, source_size, target, taken) for a table with doc_id, text and source."""
    return rf"""
sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, substring(md5(coalesce(doc_id::VARCHAR, '')), 1, 12) AS h FROM {documents}),
per AS (SELECT source, sum(size)::DOUBLE AS s FROM sized GROUP BY source),
weighed AS (SELECT source, s, 3 * s AS cap, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM per),
filled AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, s, CASE WHEN cap / w <= level THEN cap ELSE max(level) FILTER (cap / w > level) OVER () * w END AS target FROM filled),
shared AS (
  SELECT *, floor(coalesce(target / nullif(s, 0), 0) + 1e-12)::BIGINT AS base FROM planned),
steps AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h),
limits AS (
  SELECT p.source, greatest(0.0, p.target - p.base * p.s) AS budget, max(h) FILTER (upto <= greatest(0.0, p.target - p.base * p.s)) AS inside,
    coalesce(max(upto) FILTER (upto <= greatest(0.0, p.target - p.base * p.s)), 0) AS below,
    min(h) FILTER (upto > greatest(0.0, p.target - p.base * p.s)) AS beyond, min(upto) FILTER (upto > greatest(0.0, p.target - p.base * p.s)) AS over
  FROM shared p JOIN steps t ON t.source IS NOT DISTINCT FROM p.source GROUP BY p.source, p.target, p.base, p.s),
cuts AS (SELECT source, CASE WHEN over - budget < budget - below THEN beyond ELSE inside END AS cut FROM limits),
taken AS (
  SELECT z.doc_id, z.size, p.s::BIGINT AS source_size, round(p.target, 6) AS target, p.base + coalesce((z.h <= c.cut)::BIGINT, 0) AS copies
  FROM sized z JOIN shared p ON p.source IS NOT DISTINCT FROM z.source JOIN cuts c ON c.source IS NOT DISTINCT FROM z.source)"""


_OP11 = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first_id < doc_id, false)::INT AS mask
  FROM worded LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
found AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": _OP11,
        "op1_chat_formatting": _OP1,
        "op2_line_dedup": _OP2,
        "op3_ngram_jaccard_join": _OP3,
        "op6_quality_rules": _OP6,
        "op10_source_mixing": f"WITH {mixing_sql()} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM taken",
    }
