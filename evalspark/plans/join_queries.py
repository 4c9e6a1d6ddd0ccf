"""Queries of joins with rules for several matches and for none, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import joins as J
from evalspark.plans.catalog import query
from evalspark.session import table


@query(r"""
WITH cat AS (SELECT p_partkey AS record_id, p_brand AS b, p_type AS t, p_size AS s, p_name FROM part),
k AS (SELECT b, t, s, count(*) AS n, any_value(p_name) AS p_name FROM cat GROUP BY ALL),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey WHEN l_linenumber % 3 = 1 AND l_partkey % 10 = 0 THEN -1 END AS record_id, p.p_brand AS b, CASE WHEN l_linenumber = 5 THEN '' ELSE p.p_type END AS t, CASE WHEN l_linenumber = 7 THEN 99 ELSE p.p_size END AS s FROM lineitem JOIN part p ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x.record_id IS NOT NULL THEN c.p_name WHEN x.t = '' THEN NULL WHEN k.n = 1 THEN k.p_name END AS p_name,
  CASE WHEN x.record_id IS NOT NULL THEN CASE WHEN c.p_name IS NULL THEN 'missing' ELSE 'id' END WHEN x.t = '' THEN 'incomplete' WHEN k.n = 1 THEN 'keys' WHEN k.n > 1 THEN 'ambiguous' ELSE 'missing' END AS found
FROM x LEFT JOIN cat c USING (record_id) LEFT JOIN k ON k.b = x.b AND k.t = x.t AND k.s = x.s""")
def subset_lookup(spark, sf_dir):
    """Records by id where one is named, else by three keys; ambiguous, incomplete and missing ones are told."""
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"), "p_name")
    n = F.col("l_linenumber")
    x = table(spark, sf_dir, "lineitem").join(catalog.drop("p_name").withColumnRenamed("record_id", "l_partkey"), "l_partkey")
    x = x.select("l_orderkey", n, "l_partkey", F.when(n % 3 == 0, F.col("l_partkey")).when((n % 3 == 1) & (F.col("l_partkey") % 10 == 0), -1).alias("record_id"), "b", F.when(n == 5, "").otherwise(F.col("t")).alias("t"), F.when(n == 7, 99).otherwise(F.col("s")).alias("s"))
    return J.lookup(x, catalog, "record_id", ["b", "t", "s"], ["p_name"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "found")


@query(r"""
WITH idx AS (SELECT 'o' || o_custkey AS key, o_orderkey AS path FROM orders UNION ALL SELECT 'n' || c_nationkey, -c_custkey FROM customer WHERE c_custkey % 50 = 0),
n AS (SELECT key, min(path) AS path, count(*) AS n FROM idx GROUP BY key),
e AS (SELECT c_custkey, unnest(['x' || c_custkey, 'o' || c_custkey, 'n' || c_nationkey]) AS key, unnest([0, 1, 2]) AS pos FROM customer),
f AS (SELECT c_custkey, min({'pos': pos, 'key': key, 'path': path, 'n': n}) AS m FROM e JOIN n USING (key) GROUP BY c_custkey)
SELECT c_custkey, m.key AS key, CASE WHEN m.n = 1 THEN m.path END AS path, CASE WHEN m IS NULL THEN 'missing' WHEN m.n > 1 THEN 'ambiguous' ELSE 'attached' END AS found FROM customer LEFT JOIN f USING (c_custkey)""")
def candidate_coalesce_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    index = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("key"), F.col("o_orderkey").alias("path"))
    index = index.unionByName(c.filter("c_custkey % 50 = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("key"), (-F.col("c_custkey")).alias("path")))
    name = lambda p, k: F.concat(F.lit(p), k)
    return J.first_candidate(c, index, "c_custkey", F.array(name("x", "c_custkey"), name("o", "c_custkey"), name("n", "c_nationkey")))


@query(r"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE '' END AS pred, 'ar-' || doc_id AS sid FROM documents),
a AS (SELECT doc_id::VARCHAR AS key, 'q' || min(quality) AS value FROM labels GROUP BY 1), b AS (SELECT item_id AS key, 'b' || item_id AS value FROM benchmark)
SELECT x.doc_id, CASE WHEN pred <> '' THEN pred ELSE coalesce(a.value, b.value) END AS pred, CASE WHEN pred <> '' THEN NULL WHEN a.value IS NOT NULL THEN 'id' WHEN b.value IS NOT NULL THEN 'path' END AS pred_source
FROM x LEFT JOIN a ON a.key = substr(sid, 4) LEFT JOIN b ON b.key = x.doc_id // 10""")
def prediction_fill(spark, sf_dir):
    """Missing predictions by the id without its prefix, else by path."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "own").otherwise("").alias("pred"), F.concat(F.lit("ar-"), "doc_id").alias("sid"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("q"), "quality").alias("value"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.lit("b"), "item_id").alias("value"))
    out = J.fill(x, "pred", [("id", labels, F.regexp_replace("sid", "^ar-", "")), ("path", items, F.floor(F.col("doc_id") / 10))])
    return out.select("doc_id", "pred", "pred_source")


@query(r"SELECT d.doc_id, d.lang, coalesce(l.n, 0)::BIGINT AS annotations FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE quality = 1 GROUP BY doc_id) l USING (doc_id)")
def done_annotations(spark, sf_dir):
    """Samples beside their annotations that are done."""
    done = table(spark, sf_dir, "labels").filter("quality = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(done, "doc_id", "left").select("doc_id", "lang", F.coalesce("n", F.lit(0).cast("long")).alias("annotations"))


@query(r"SELECT page_id, regexp_replace(html, '[\x00-\x1F\x7F]', '', 'g') AS cell, CASE WHEN length(html) > 32767 THEN left(html, 32753) || '...[truncated]' ELSE html END AS clipped FROM pages")
def sample_view(spark, sf_dir):
    """Cells of the per-sample view: without control characters, and no longer than a cell."""
    return table(spark, sf_dir, "pages").select("page_id", J.control_free(F.col("html")).alias("cell"), J.clipped_cell(F.col("html")).alias("clipped"))
