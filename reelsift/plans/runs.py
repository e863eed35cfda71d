"""Queries of feedback sinks, gates, moves of configs and profiles, exports and progress; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelsift.functions import columns as X
from reelsift.operators import evaluate, feedback, lab, review
from reelsift.operators import rerank as rr
from reelsift.operators import vectors as vec
from reelsift.plans import registry as r
from reelsift.plans import tables as t
from reelsift.sources import files
from reelsift.streaming import jobs

# Candidates and feedback --------------------------------------------------------------------------------------------

_RESULTS = """rs AS (SELECT 'run' || (l_suppkey % 3) AS run_id, 'c' || l_linenumber AS run_candidate_id, 'v' || (l_partkey % 300) AS sha256, (l_linenumber * 1.5)::DOUBLE AS s,
 (l_linenumber * 1.5 + l_quantity % 7 + 0.25)::DOUBLE AS e, CASE WHEN l_linenumber % 3 <> 0 THEN ' ' || l_linestatus END AS emotion, l_returnflag AS scene, l_returnflag AS tag FROM lineitem),
ri AS (SELECT *, 'cand_' || sha256(sha256 || s || e || run_candidate_id) AS id FROM rs)"""


def _results(spark, d):
    n = F.col("l_linenumber")
    start = (n * 1.5).cast("double")
    return t.table(spark, d, "lineitem").select(
        F.concat(F.lit("run"), (F.col("l_suppkey") % 3).cast("string")).alias("run_id"), F.concat(F.lit("c"), n.cast("string")).alias("run_candidate_id"), F.concat(F.lit("v"), (F.col("l_partkey") % 300).cast("string")).alias("sha256"),
        start.alias("start"), (start + F.col("l_quantity") % 7 + 0.25).cast("double").alias("end"), F.when(n % 3 != 0, F.concat(F.lit(" "), "l_linestatus")).alias("emotion"), F.col("l_returnflag").alias("scene"), F.array("l_returnflag").alias("tags"),
    )


@r.query(f"WITH {_RESULTS} SELECT id AS candidate_id, min(run_id) AS run_id, 'candidate' AS status FROM ri WHERE id NOT IN (SELECT id FROM ri WHERE run_id = 'run0') GROUP BY 1")
def materialized_candidates(spark, d):
    rows = _results(spark, d)
    known = rows.where("run_id = 'run0'").select(files.candidate_id(F.col("sha256"), F.col("start"), F.col("end"), F.col("run_candidate_id")).alias("candidate_id")).distinct()
    return files.materialize(rows, known).select("candidate_id", "run_id", "status")


_RECORD = f"""{t.EVENTS}, k AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'promoted' END AS status FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT ev.event_id, target_id, CASE WHEN event_id % 11 = 0 THEN 'maybe' ELSE rating END AS rating, created_at, k.status AS known FROM ev LEFT JOIN k ON k.id = target_id),
g AS (SELECT *, CASE rating WHEN 'like' THEN 'liked' WHEN 'dislike' THEN 'disliked' WHEN 'neutral' THEN 'reviewed' END AS x FROM f WHERE rating IN ('like', 'dislike', 'neutral', 'skip', 'quality_reject', 'favorite')),
w AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), known) AS previous_status FROM g)"""


def _recorded(spark, d):
    e = t.events(spark, d).select("event_id", "target_id", F.when(F.col("event_id") % 11 == 0, "maybe").otherwise(F.col("rating")).alias("rating"), "created_at")
    known = t.table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("promoted").alias("status"))
    return feedback.record(e, known)


@r.query(f"WITH {_RECORD} SELECT event_id, rating, previous_status, 'feedback' AS event_kind FROM w")
def recorded_feedback(spark, d):
    return _recorded(spark, d)[0].select("event_id", "rating", "previous_status", "event_kind")


@r.query(f"WITH {_RECORD} SELECT * FROM (SELECT target_id AS id, arg_max(x, (created_at, event_id)) AS status, min(known) AS was FROM g WHERE x IS NOT NULL AND known IS NOT NULL GROUP BY 1) WHERE status <> was")
def recorded_statuses(spark, d):
    known = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "candidate").otherwise("promoted").alias("was"))
    return _recorded(spark, d)[2].join(known, "id")


@r.query(f"WITH {t.EVENTS} SELECT created_at <= TIMESTAMP '2024-01-20' AS training, rating, count(*) AS n FROM ev GROUP BY 1, 2")
def watermark_split(spark, d):
    a, b = feedback.until(t.events(spark, d), F.lit("2024-01-20").cast("timestamp"))
    return a.withColumn("training", F.lit(True)).union(b.withColumn("training", F.lit(False))).groupBy("training", "rating").agg(F.count("*").alias("n"))


_MODELS = "(SELECT vec_id AS id, 'm' AS model, len(embedding) AS dim FROM embeddings WHERE vec_id % 23 <> 4)"


def _modelled(spark, d):
    return t.table(spark, d, "embeddings").where("vec_id % 23 <> 4").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"), F.size("embedding").alias("dim"))


@r.query(f"""WITH g AS ({r.ORACLE_SQL["profile_gates"]}), {t.EVENTS}, v AS (SELECT count(*) AS targets, count(*) FILTER (target_id IN (SELECT id FROM {_MODELS} WHERE dim = 64)) AS covered FROM (SELECT DISTINCT target_id FROM pro))
SELECT g.* EXCLUDE (reasons, ready), targets, covered, concat_ws('; ', nullif(reasons, ''), CASE WHEN covered < targets THEN 'targets without a vector' END) AS reasons, ready AND covered >= targets AS ready FROM g, v""")
def profile_preview(spark, d):
    return feedback.profile_preview(feedback.profile_events(t.events(spark, d)), _modelled(spark, d), "m", 64).drop("watermark")


@r.query(f"""WITH c AS (SELECT (SELECT count(*) FROM embeddings) AS total, (SELECT count(*) FROM labels WHERE doc_id % 3 = 0) AS indexed, (SELECT count(DISTINCT id) FROM {_MODELS} WHERE dim = 64) AS available)
SELECT *, total - available AS missing, indexed >= total AND available >= total AS complete,
 concat_ws('; ', CASE WHEN indexed < total THEN 'indexed ' || indexed || ' of ' || total END, CASE WHEN available < total THEN 'with vectors ' || available || ' of ' || total END) AS diagnosis FROM c""")
def index_health(spark, d):
    return vec.index_health(t.vectors(spark, d), t.table(spark, d, "labels").where("doc_id % 3 = 0"), _modelled(spark, d), "m", 64)


@r.query(f"WITH {t.EVENTS}, {t.CANDIDATES} SELECT DISTINCT key FROM wei JOIN cand ON id = target_id WHERE key IS NOT NULL")
def profile_scenario_keys(spark, d):
    e = feedback.profile_events(t.events(spark, d)).join(t.candidates(spark, d).select(F.col("id").alias("target_id"), F.explode("keys").alias("key")), "target_id")
    return rr.scenario_union(e.where("rating <> 'dislike'"), e.where("rating = 'dislike'"))


@r.query(f"WITH {t.CANDIDATES} SELECT id, round(base, 6) AS final_score, concat_ws('; ', 'disabled', CASE WHEN vector IS NULL THEN 'no vector' END, CASE WHEN key IS NULL THEN 'no keys' ELSE 'no scenario' END) AS reasons FROM cand")
def rerank_disabled(spark, d):
    g, s = r._profile(spark, d)
    return rr.rerank(t.candidates(spark, d), g, s, enabled=False).select("id", "final_score", "reasons")


@r.query(f"WITH {t.LABELLED}, b AS (SELECT min(score) AS lo, max(score) AS hi FROM lb) SELECT id, round(coalesce(CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 0), 6) AS scaled FROM lb, b")
def scaled_scores(spark, d):
    rows = t.labelled(spark, d)
    span = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return rows.crossJoin(F.broadcast(span)).select("id", F.round(X.min_max(F.col("score"), F.col("lo"), F.col("hi")), 6).alias("scaled"))


@r.query(f"WITH {t.LABELLED} SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rank FROM lb")
def global_ranks(spark, d):
    return evaluate.global_rank(t.labelled(spark, d).select("id", "score"), "score").select("id", "rank")


@r.query()
def near_keepers(spark, d):
    return review.near_keepers(r._near_rows(spark, d), 0.3).select("id", "keeper", F.round("similarity", 6).alias("similarity"))


# Lab ----------------------------------------------------------------------------------------------------------------


@r.query("SELECT o_custkey % 40 AS session, min(o_orderkey) AS pair_index FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 4 <> 1 GROUP BY 1")
def next_unjudged_pairs(spark, d):
    pairs = t.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("session"), F.col("o_orderkey").alias("pair_index"))
    return lab.next_pairs(pairs, pairs.where("not (pair_index % 5 = 0 and session % 4 <> 1)"))


_LOG = "lg AS (SELECT o_custkey % 100 AS slot, o_orderkey AS id, o_orderdate AS a, o_orderpriority AS config, CASE WHEN o_orderkey % 4 = 0 THEN 'rollback' ELSE 'promote' END AS action FROM orders)"


@r.query(f"""WITH {_LOG}, n AS (SELECT slot, arg_max(config, (a, id)) AS current FROM lg GROUP BY 1)
SELECT slot, current, arg_max(config, (a, id)) AS target FROM lg JOIN n USING (slot) WHERE action = 'promote' AND config <> current GROUP BY 1, 2""")
def champion_rollbacks(spark, d):
    k = F.col("o_orderkey")
    log = t.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("slot"), k.alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("config"), F.when(k % 4 == 0, "rollback").otherwise("promote").alias("action"))
    return lab.rollback_targets(log)


_PUBLISH = """bl AS (SELECT c_custkey AS version, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM customer WHERE c_custkey % 7 <> 0),
pb AS (SELECT o_orderkey % 50 AS slot, o_custkey AS version, epoch_us(o_orderdate::TIMESTAMP) + o_orderkey AS a, o_orderkey % 2 = 0 AS new, status FROM orders LEFT JOIN bl ON version = o_custkey)"""


def _published(spark, d):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
    rows = t.table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("slot"), F.col("o_custkey").alias("version"), at.alias("at"), (F.col("o_orderkey") % 2 == 0).alias("new"))
    builds = t.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("version"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("completed").alias("status"))
    return lab.publish(rows.where("not new"), rows.where("new"), builds)


@r.query(f"WITH {_PUBLISH}, l AS (SELECT *, lag(version) OVER (PARTITION BY slot ORDER BY a, new, version) AS previous FROM pb WHERE NOT new OR status = 'completed') SELECT slot, version, a AS at, previous FROM l WHERE new")
def profile_publications(spark, d):
    return _published(spark, d)[0]


@r.query(f"WITH {_PUBLISH} SELECT slot, version, a AS at, CASE WHEN status IS NULL THEN 'no build' ELSE 'not completed' END AS reason FROM pb WHERE new AND coalesce(status, '') <> 'completed'")
def publication_rejects(spark, d):
    return _published(spark, d)[1]


@r.query(f"WITH {t.STAGES} SELECT video, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'needs_attention') AS needs_attention FROM st WHERE stage = 'gif_clip' AND status IN ('succeeded', 'failed', 'cancelled', 'needs_attention') GROUP BY 1")
def clip_outcomes(spark, d):
    return lab.clip_outcomes(t.stages(spark, d))


@r.query(f"WITH j AS ({r.ORACLE_SQL['job_statuses']}) SELECT count(*) AS total, count(*) FILTER (job_status IN ('pending', 'running', 'leased', 'retry_wait')) AS active, count(*) FILTER (job_status = 'pending') AS pending, count(*) FILTER (job_status = 'succeeded') AS succeeded, count(*) FILTER (job_status = 'needs_attention') AS needs_attention, count(*) FILTER (job_status = 'cancelled') AS cancelled FROM j")
def job_counts(spark, d):
    return lab.job_counts(r.job_statuses(spark, d).select(F.col("job_status").alias("status")))


@r.query(f"WITH i AS ({r.ORACLE_SQL['attention_inbox']}) SELECT count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM i")
def inbox_severities(spark, d):
    return lab.severity_counts(r.attention_inbox(spark, d))


@r.query("""WITH s AS (SELECT p_size AS config, p_type AS key, max(p_brand) AS value FROM part GROUP BY 1, 2),
j AS (SELECT config, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS settings FROM s GROUP BY 1) SELECT config, sha256(settings) AS config_id, settings FROM j""")
def config_snapshots(spark, d):
    return lab.config_snapshots(t.table(spark, d, "part").select(F.col("p_size").alias("config"), F.col("p_type").alias("key"), F.col("p_brand").alias("value")))


# Exports and progress -----------------------------------------------------------------------------------------------


@r.query("""SELECT o_orderkey AS collection, sha256('[' || string_agg('"' || l_partkey || '"', ', ' ORDER BY l_partkey::VARCHAR) || ']') AS manifest_hash FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def collection_hashes(spark, d):
    ids = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("collection")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("ids"))
    ids = ids.join(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("collection")), "collection", "left_semi")
    return ids.select("collection", X.ids_hash(F.col("ids")).alias("manifest_hash"))


_ITEMS = """it AS (SELECT l_orderkey AS collection, (l_linenumber % 2)::BIGINT AS version, l_linenumber AS rank, l_partkey AS id FROM lineitem),
la AS (SELECT * FROM it QUALIFY version = max(version) OVER (PARTITION BY collection)), ca AS (SELECT p_partkey AS id, p_brand FROM part WHERE p_partkey % 6 <> 1)"""


def _exported(spark, d):
    items = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("collection"), (F.col("l_linenumber") % 2).cast("long").alias("version"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    return files.collection_manifest(items, t.table(spark, d, "part").where("p_partkey % 6 <> 1").select(F.col("p_partkey").alias("id"), "p_brand"))


@r.query(f"WITH {_ITEMS} SELECT collection, version, row_number() OVER (PARTITION BY collection ORDER BY rank, la.id) - 1 AS rank, la.id, p_brand FROM la JOIN ca USING (id)")
def collection_export(spark, d):
    return _exported(spark, d)[0].select("collection", "version", "rank", "id", "p_brand")


@r.query(f"WITH {_ITEMS} SELECT collection, version, count(ca.id) AS exported, count(*) - count(ca.id) AS missing FROM la LEFT JOIN ca USING (id) GROUP BY 1, 2")
def collection_manifests(spark, d):
    return _exported(spark, d)[2]


def _scored(spark, d):
    e = t.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") != "view", "done").otherwise("pending")
    return e.select(kind.alias("status"), F.col("ts").cast("timestamp").alias("finished_at"))


_SCORED = "sd AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'done' END AS status, ts FROM events)"
_RATES = f"{_SCORED}, ra AS (SELECT epoch_us(ts) // 600000000 AS b, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM sd WHERE status <> 'pending' GROUP BY 1)"


@r.query(f"WITH {_SCORED} SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM sd")
def frame_progress(spark, d):
    return jobs.progress(_scored(spark, d))


@r.query(f"WITH {_RATES} SELECT b * 600 AS start_sec, done, failed, round(600 / (done + failed), 6) AS seconds_each FROM ra")
def frame_throughput(spark, d):
    return jobs.throughput(_scored(spark, d)).select(F.unix_seconds("start").alias("start_sec"), "done", "failed", "seconds_each")


@r.query(f"WITH {_RATES}, p AS (SELECT count(*) AS pending FROM sd WHERE status = 'pending'), s AS (SELECT round(600 / arg_max(done + failed, b), 6) AS seconds_each FROM ra) SELECT pending, seconds_each, round(pending * seconds_each / 3600, 6) AS hours FROM p, s")
def frame_hours_left(spark, d):
    return jobs.remaining(jobs.progress(_scored(spark, d)), jobs.throughput(_scored(spark, d)))
