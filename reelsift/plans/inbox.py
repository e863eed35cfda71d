"""Queries of the attention inbox by its sources, and of what names a collection or a config; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift.operators import attention, lab
from reelsift.plans import registry as r
from reelsift.plans import runs
from reelsift.plans import tables as t
from reelsift.sources import files


def _media(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("media_id"), F.sha2(F.concat("p_brand", F.col("p_size").cast("string")), 256).alias("sha256"), F.timestamp_seconds("p_partkey").alias("created_at"))


_MEDIA = "md AS (SELECT p_partkey AS id, sha256(p_brand || p_size) AS sha, p_partkey AS made FROM part)"


@r.query(f"""WITH {t.CANDIDATES}, {_MEDIA},
jb AS (SELECT o_orderkey AS job, '/films/' || o_custkey AS directory, o_orderstatus, epoch(o_orderdate)::BIGINT AS made FROM orders),
st AS (SELECT l_orderkey * 10 + l_linenumber AS stage, l_orderkey AS job, l_linenumber, l_linestatus, epoch(l_shipdate)::BIGINT AS made FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT job FROM jb)),
du AS (SELECT sha, count(*) AS n, min(made) AS made, list_sort(list(id)) AS ids FROM md GROUP BY 1 HAVING count(*) > 1),
pb AS (SELECT s_suppkey AS id, 'v' || s_nationkey AS v, CASE WHEN s_suppkey % 5 <> 0 THEN 'v' || (s_nationkey + 1) END AS p FROM supplier),
i AS (SELECT 'task_failure' AS kind, 'job:' || job AS key, 'error' AS severity, 'Task job needs attention: ' || directory AS title, 'Job ' || job || ' is in ''needs_attention'' status.' AS detail, 'View Job' AS action_label, '/api/tasks/jobs/' || job AS action_target, made FROM jb WHERE o_orderstatus = 'P'
UNION ALL SELECT 'task_failure', 'stage:' || stage, 'warning', 'Stage ''' || CASE WHEN l_linenumber > 4 THEN 'gif_clip' ELSE 'score' END || ''' needs attention', CASE l_linenumber % 4 WHEN 0 THEN 'disk full' WHEN 1 THEN 'no answer from ' || l_linestatus WHEN 2 THEN 'No error details recorded.' ELSE 'stopped by ' || l_linestatus END, 'View Job', '/api/tasks/jobs/' || job, made FROM st
UNION ALL SELECT 'migration_conflict', 'sha256:' || sha, 'warning', 'Duplicate media (' || n || ' copies)', 'SHA256 ' || substr(sha, 1, 16) || '... appears in ' || n || ' media records. Media IDs: ' || array_to_string(ids[1:100], ',') || CASE WHEN n > 100 THEN ',...' ELSE '' END, 'Resolve', '/api/workbench/conflicts?sha256=' || sha, made FROM du
UNION ALL SELECT 'profile_publish', 'pub:' || id, 'info', CASE WHEN p IS NULL THEN 'Initial profile published: ' || v ELSE 'Profile published: ' || p || ' -> ' || v END, CASE WHEN p IS NULL THEN 'The first preference profile has been published and is now active.' ELSE 'Preference profile was updated from ' || p || ' to ' || v || ' and is now active.' END, 'View Profile', '/api/preference/profile/' || v, id * 60 FROM pb
UNION ALL SELECT 'high_value_review', 'cand:' || id, 'info', printf('High-value candidate: score %.2f', base), printf('Candidate %d from /v/%d scored %.2f and awaits review.', id, source, base), 'Review', '/api/candidates/' || id, id * 3600 FROM cand WHERE id % 4 <> 1 AND base >= 0.7
UNION ALL SELECT 'champion_promotion', 'event:' || c_custkey, 'info', 'Champion config promoted: ' || c_mktsegment, 'Configuration ' || c_mktsegment || ' was promoted to champion.', 'View History', '/api/quality/champions/history', c_custkey * 7 FROM customer WHERE c_custkey % 3 <> 0)
SELECT 'att_' || substr(sha256(kind || ':' || key), 1, 16) AS attention_id, kind, severity, title, detail, action_label, action_target, made AS seconds FROM i""")
def attention_items(spark, d):
    """All items of the six sources, each read from its own table."""
    o, li, c = t.table(spark, d, "orders"), t.table(spark, d, "lineitem"), t.table(spark, d, "customer")
    text = lambda word, name: F.concat(F.lit(word), F.col(name).cast("string"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), text("/films/", "o_custkey").alias("directory"), F.when(F.col("o_orderstatus") == "P", "needs_attention").otherwise("succeeded").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    n = F.col("l_linenumber")
    error = F.when(n % 4 == 0, '{"error": "E7", "message": "disk full"}').when(n % 4 == 1, F.concat(F.lit('{"error": "no answer from '), "l_linestatus", F.lit('"}'))).when(n % 4 == 3, F.concat(F.lit(" stopped by "), "l_linestatus", F.lit("\n")))
    stages = li.select((F.col("l_orderkey") * 10 + n).alias("stage_id"), F.col("l_orderkey").alias("video_id"), F.when(n > 4, "gif_clip").otherwise("score").alias("stage_name"), F.when(F.col("l_returnflag") == "R", "needs_attention").otherwise("succeeded").alias("status"), error.alias("last_error"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    videos = o.select(F.col("o_orderkey").alias("video_id"), F.col("o_orderkey").alias("job_id"))
    log = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("publication_id"), text("v", "s_nationkey").alias("version"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("v"), (F.col("s_nationkey") + 1).cast("string"))).alias("previous"), F.timestamp_seconds(F.col("s_suppkey") * 60).alias("created_at"))
    cand = t.candidates(spark, d).select("id", text("/v/", "source").alias("source_video_path"), F.when(F.col("id") % 4 != 1, "candidate").otherwise("promoted").alias("status"), F.col("base").alias("final_score"), F.timestamp_seconds(F.col("id") * 3600).alias("created_at"))
    champions = c.select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("config"), F.when(F.col("c_custkey") % 3 != 0, "promote").otherwise("rollback").alias("action"), F.timestamp_seconds(F.col("c_custkey") * 7).alias("created_at"))
    sources = [attention.job_failures(jobs), attention.stage_failures(stages, videos, jobs), attention.duplicate_media(_media(spark, d)), attention.profile_publishes(log), attention.high_value_reviews(cand), attention.champion_promotions(champions)]
    return attention.attention(sources, None).withColumn("seconds", F.unix_seconds("created_at")).drop("created_at")


@r.query(f"WITH {_MEDIA} SELECT sha AS sha256, id AS media_id, count(*) OVER w AS n, min(made) OVER w AS first FROM md WINDOW w AS (PARTITION BY sha) QUALIFY count(*) OVER w > 1")
def media_copies(spark, d):
    return attention.copies(_media(spark, d)).withColumn("first", F.unix_seconds("first"))


@r.query("""WITH s AS (SELECT p_size AS config, p_type AS key, max(p_brand) AS value FROM part GROUP BY 1, 2), v AS (SELECT p_size AS config, p_brand AS key, max(p_name) AS value FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2),
j AS (SELECT config, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS settings FROM s GROUP BY 1), k AS (SELECT config, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS provenance FROM v GROUP BY 1)
SELECT config, sha256(settings) AS config_id, settings, coalesce(provenance, '{}') AS provenance FROM j LEFT JOIN k USING (config)""")
def config_provenance(spark, d):
    p = t.table(spark, d, "part")
    entries = lambda key, value: p.select(F.col("p_size").alias("config"), F.col(key).alias("key"), F.col(value).alias("value"))
    return lab.config_snapshots(entries("p_type", "p_brand"), entries("p_brand", "p_name").where("config % 3 <> 0"))


def _named(spark, d):
    o = t.table(spark, d, "orders").where("o_orderkey % 8 <> 3")
    known = o.select(F.col("o_orderkey").alias("collection"), "o_orderpriority").union(t.table(spark, d, "supplier").select(-F.col("s_suppkey") - 1, F.lit("none")))
    return files.named_manifests(runs._exported(spark, d)[2], known.select("collection", F.col("o_orderpriority").alias("name"), F.when(F.col("collection") % 2 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("q")))).alias("search")))


@r.query(f"""WITH m AS ({r.ORACLE_SQL['collection_manifests']}) SELECT collection, o_orderpriority AS name, version, CASE WHEN o_orderkey % 2 = 0 THEN '{{"q":"' || o_orderpriority || '"}}' ELSE '{{}}' END AS search, exported, missing FROM m JOIN orders ON o_orderkey = collection WHERE o_orderkey % 8 <> 3""")
def named_manifests(spark, d):
    return _named(spark, d)[0]


@r.query("SELECT o_orderkey AS collection, o_orderpriority AS name FROM orders WHERE o_orderkey % 8 <> 3 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT -s_suppkey - 1, 'none' FROM supplier")
def unexported_collections(spark, d):
    return _named(spark, d)[1]
