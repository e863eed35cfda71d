"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsift.functions import columns as X
from reelsift.operators import catalog, clips, evaluate, explain, feedback, lab, library, lineage, quality, review, search
from reelsift.operators import rerank as rr
from reelsift.operators import vectors as vec
from reelsift.plans import tables as t
from reelsift.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Feedback -----------------------------------------------------------------------------------------------------------


@query(f"WITH {t.EVENTS} SELECT target_id, event_id, rating FROM lat")
def feedback_latest(spark, d):
    return feedback.latest(feedback.effective(t.events(spark, d))).select("target_id", "event_id", "rating")


@query(f"WITH {t.EVENTS} SELECT rating, count(*) AS n FROM eff WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY 1")
def feedback_effective_before(spark, d):
    return feedback.effective(t.events(spark, d), F.lit("2024-01-20").cast("timestamp")).groupBy("rating").agg(F.count("*").alias("n"))


@query(f"""WITH {t.EVENTS} SELECT target_id, event_id, rating FROM ev WHERE undone_at IS NULL AND rating IN ('like', 'dislike', 'favorite')
QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, event_id DESC) = 1""")
def feedback_profile_reference_mode(spark, d):
    return feedback.profile_events(t.events(spark, d), "reference").select("target_id", "event_id", "rating")


@query(f"""WITH {t.EVENTS}, s AS (SELECT *, CASE rating WHEN 'like' THEN 'liked' WHEN 'dislike' THEN 'disliked' WHEN 'neutral' THEN 'reviewed' END AS x FROM ev)
SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'candidate') AS status,
 coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'candidate') AS previous_status FROM s""")
def feedback_status_replay(spark, d):
    return feedback.with_status(t.events(spark, d)).select("event_id", "status", "previous_status")


@query(f"""WITH {t.EVENTS}, b AS (SELECT source, count(*) AS n, count(*) FILTER (rating <> 'dislike') AS p FROM pro GROUP BY 1),
g AS (SELECT sum(n)::BIGINT AS effective, sum(p)::BIGINT AS positive, (sum(n) - sum(p))::BIGINT AS negative, count(*) AS sources, round(max(n) / sum(n), 6) AS max_share FROM b)
SELECT *, concat_ws('; ', CASE WHEN effective < 30 THEN 'too few events' END, CASE WHEN positive < 15 THEN 'too few likes' END, CASE WHEN negative < 10 THEN 'too few dislikes' END,
 CASE WHEN sources < 3 THEN 'too few sources' END, CASE WHEN max_share > 0.4 THEN 'one source dominates' END) AS reasons,
 effective >= 30 AND positive >= 15 AND negative >= 10 AND sources >= 3 AND max_share <= 0.4 AS ready FROM g""")
def profile_gates(spark, d):
    return feedback.gates(feedback.profile_events(t.events(spark, d))).drop("watermark")


@query(f"WITH {t.EVENTS} SELECT target_id, rating, round(weight, 6) AS weight FROM wei")
def feedback_weights(spark, d):
    return feedback.weighted(feedback.profile_events(t.events(spark, d))).select("target_id", "rating", F.round("weight", 6).alias("weight"))


@query("""WITH w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS tag FROM documents), c AS (SELECT tag, count(*) AS n FROM w GROUP BY 1)
SELECT tag, n, round(n / (SELECT max(n) FROM c), 6) AS weight FROM c""")
def tag_weights(spark, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return feedback.tag_weights(t.table(spark, d, "documents").select(words.alias("tags")))


@query(f"WITH {t.EVENTS} SELECT target_id, arg_min(event_id, (created_at, event_id)) AS event_id FROM ev WHERE rating = 'favorite' GROUP BY 1")
def favorites(spark, d):
    return feedback.favorites(t.events(spark, d)).select("target_id", "event_id")


@query("""WITH p AS (SELECT event_id AS pair_id, event_id % 500 AS winner, (event_id + 7) % 500 AS loser FROM events WHERE event_type = 'click')
SELECT pair_id, winner AS target_id, 'like' AS rating, 'over ' || loser AS note FROM p UNION ALL SELECT pair_id, loser, 'dislike', 'under ' || winner FROM p""")
def pairwise_feedback(spark, d):
    e = t.table(spark, d, "events").where("event_type = 'click'")
    return feedback.comparisons(e.select(F.col("event_id").alias("pair_id"), (F.col("event_id") % 500).alias("winner"), ((F.col("event_id") + 7) % 500).alias("loser")))


def _fixes(spark, d):
    e = t.events(spark, d)
    return e, e.where("event_id % 29 = 0").select((F.col("event_id") * 2).alias("event_id"), "rating", F.lit("fixed").alias("note"), "created_at")


@query(f"""WITH {t.EVENTS}, w AS (SELECT event_id * 2 AS event_id, rating FROM ev WHERE event_id % 29 = 0)
SELECT w.event_id, w.rating, CASE WHEN e.event_id IS NULL THEN 'unknown' ELSE 'superseded' END AS reason FROM w LEFT JOIN ev e USING (event_id)
WHERE e.event_id IS NULL OR w.event_id IN (SELECT supersedes_event_id FROM ev WHERE supersedes_event_id IS NOT NULL)""")
def correction_rejects(spark, d):
    return feedback.corrections(*_fixes(spark, d))[1]


@query(f"""WITH {t.EVENTS}, w AS (SELECT event_id * 2 AS event_id, rating FROM ev WHERE event_id % 29 = 0)
SELECT 'fix_' || w.event_id AS event_id, e.target_id, e.source, w.rating, w.event_id AS supersedes_event_id FROM w JOIN ev e USING (event_id)
WHERE w.event_id NOT IN (SELECT supersedes_event_id FROM ev WHERE supersedes_event_id IS NOT NULL)""")
def correction_appends(spark, d):
    return feedback.corrections(*_fixes(spark, d))[0].select("event_id", "target_id", "source", "rating", "supersedes_event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def enum_rejects(spark, d):
    return feedback.expect(t.table(spark, d, "events"), "event_type", ["click", "view", "purchase"])[1].groupBy("event_type").agg(F.count("*").alias("n"))


# Profile and reranking ----------------------------------------------------------------------------------------------

_PROFILE = f"""{t.EVENTS}, {t.CANDIDATES},
pv AS (SELECT w.target_id, CASE WHEN rating = 'dislike' THEN 'd' ELSE 'l' END AS side, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM wei w JOIN vec ON w.target_id = vec.id),
cm AS (SELECT side, p, sum(weight * x) / sum(weight) AS x FROM pv GROUP BY 1, 2),
ce AS (SELECT side, list(x ORDER BY p) AS m FROM cm GROUP BY 1),
sk AS (SELECT DISTINCT c.key, w.target_id, CASE WHEN rating = 'dislike' THEN 'd' ELSE 'l' END AS side FROM wei w JOIN cand c ON w.target_id = c.id WHERE c.key IS NOT NULL),
sc AS (SELECT key, count(*) FILTER (side = 'l') AS likes, count(*) FILTER (side = 'd') AS dislikes FROM sk GROUP BY 1 HAVING count(*) >= 8 AND abs(count(*) FILTER (side = 'l') - count(*) FILTER (side = 'd')) / count(*) >= 0.25),
sx AS (SELECT s.key, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM sk s JOIN vec ON s.target_id = vec.id WHERE side = 'l'),
sm AS (SELECT key, p, avg(x) AS x FROM sx GROUP BY 1, 2), sv AS (SELECT key, list(x ORDER BY p) AS m FROM sm GROUP BY 1)"""


def _profile(spark, d):
    v = t.vectors(spark, d).select("id", "vector")
    e = feedback.weighted(feedback.profile_events(t.events(spark, d)))
    keys = t.candidates(spark, d).select("id", F.explode("keys").alias("key"))
    return rr.global_profile(e, v), rr.scenario_profiles(e, keys, v)


@query(f"WITH {_PROFILE} SELECT round(list_sum(l.m), 6) AS liked_sum, round(l.m[1], 6) AS liked_first, round(list_sum(x.m), 6) AS disliked_sum, least(1.0::DOUBLE, (SELECT count(*) FROM wei) / 100) AS confidence FROM ce l, ce x WHERE l.side = 'l' AND x.side = 'd'")
def profile_global(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return _profile(spark, d)[0].select(F.round(total("liked"), 6).alias("liked_sum"), F.round(F.col("liked")[0], 6).alias("liked_first"), F.round(total("disliked"), 6).alias("disliked_sum"), "confidence")


@query(f"WITH {_PROFILE} SELECT sc.key, likes, dislikes, round(abs(likes - dislikes) / (likes + dislikes), 6) AS confidence, round(sv.m[1], 6) AS first FROM sc LEFT JOIN sv USING (key)")
def profile_scenarios(spark, d):
    return _profile(spark, d)[1].select("key", "likes", "dislikes", F.round("confidence", 6).alias("confidence"), F.round(F.col("centroid")[0], 6).alias("first"))


_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


@query(f"""WITH {_PROFILE},
r0 AS (SELECT c.id, c.base, c.key, c.vector IS NULL AS novec, {_COS.format(a="v.vector", b="l.m")} AS gl, {_COS.format(a="v.vector", b="x.m")} AS di, sc.key IS NOT NULL AS has, {_COS.format(a="v.vector", b="coalesce(sv.m, v.vector)")} AS sl
 FROM cand c JOIN vec v USING (id) CROSS JOIN (SELECT m FROM ce WHERE side = 'l') l CROSS JOIN (SELECT m FROM ce WHERE side = 'd') x LEFT JOIN sc ON sc.key = c.key LEFT JOIN sv ON sv.key = sc.key),
r AS (SELECT id, base, key, novec, CASE WHEN NOT novec THEN gl END AS gl, CASE WHEN NOT novec THEN di END AS di, CASE WHEN NOT novec AND has THEN sl END AS sl FROM r0)
SELECT id, round(base, 6) AS base, round(gl, 6) AS global_like, round(sl, 6) AS scenario_like, round(di, 6) AS dislike,
 round(CASE WHEN novec THEN NULL ELSE (0.25 * (gl + 1) / 2 + coalesce(0.15 * (sl + 1) / 2, 0) + 0.2 * (1 - di) / 2) / (0.45 + CASE WHEN sl IS NULL THEN 0 ELSE 0.15 END) END, 6) AS profile_score,
 round(CASE WHEN novec THEN base ELSE greatest(0, least(1, (0.55 * base + 0.25 * gl + coalesce(0.15 * sl, 0)) / (0.8 + CASE WHEN sl IS NULL THEN 0 ELSE 0.15 END) - 0.2 * di)) END, 6) AS final_score,
 concat_ws('; ', CASE WHEN novec THEN 'no vector' END, CASE WHEN key IS NULL THEN 'no keys' WHEN sl IS NULL THEN 'no scenario' END) AS reasons FROM r""")
def feedback_rerank(spark, d):
    g, s = _profile(spark, d)
    return rr.rerank(t.candidates(spark, d), g, s)


# Vectors ------------------------------------------------------------------------------------------------------------


@query(f"WITH {t.VECTORS}, u AS (SELECT id, label, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS u FROM vec), n AS (SELECT label, count(*) AS n, sum(list_dot_product(u, u)) AS own FROM u GROUP BY 1), x AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u), s AS (SELECT label, p, sum(x) AS x FROM x GROUP BY 1, 2), a AS (SELECT label, sum(x * x) AS a FROM s GROUP BY 1) SELECT label, n, round(CASE WHEN n < 2 THEN 0 ELSE 1 - (a - own) / (n * (n - 1)) END, 6) AS diversity FROM n JOIN a USING (label)")
def vector_diversity(spark, d):
    return vec.diversity(t.vectors(spark, d), ["label"])


@query(f"WITH {t.VECTORS}, s AS (SELECT q.id AS query_id, i.id, round({_COS.format(a='q.vector', b='i.vector')}, 6) AS similarity FROM vec q JOIN vec i ON q.id <> i.id WHERE q.id % 50 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10")
def nearest_neighbours(spark, d):
    v = t.vectors(spark, d)
    return vec.neighbours(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), v.select("id", "vector"), 10)


@query(f"WITH {t.VECTORS}, x AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM vec), m AS (SELECT label, p, avg(x) AS x FROM x GROUP BY 1, 2) SELECT label, (p - 1)::BIGINT AS pos, round(x, 6) AS mean FROM m")
def mean_vectors(spark, d):
    m = vec.weighted_mean(t.vectors(spark, d), ["label"])
    return m.select("label", F.posexplode("mean").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("WITH c AS (SELECT DISTINCT event_id % 700 AS id FROM events), x AS (SELECT vec_id AS id FROM embeddings WHERE len(embedding) = 64) SELECT count(*) AS total, count(*) FILTER (id IN (SELECT id FROM x)) AS available, count(*) FILTER (id % 50 = 3) AS excluded, count(*) FILTER (id NOT IN (SELECT id FROM x) AND id % 50 <> 3) AS missing FROM c")
def vector_health(spark, d):
    c = t.table(spark, d, "events").select((F.col("event_id") % 700).alias("id")).distinct()
    return vec.health(c, t.vectors(spark, d), c.where("id % 50 = 3"), 64)


@query(f"""WITH {t.VECTORS}, s AS (SELECT q.id AS q, i.label, round({_COS.format(a='q.vector', b='i.vector')}, 6) AS s, q.label AS own, i.id FROM vec q JOIN vec i ON q.id <> i.id WHERE q.id % 50 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 10),
f AS (SELECT q, greatest(0, max(s)) AS f1, greatest(0, coalesce(max(s) FILTER (label = own), 0)) AS f2, greatest(0, coalesce(avg(s) FILTER (label = own), 0)) AS f3, count(*) FILTER (s >= 0.6) / count(*) AS f4 FROM k GROUP BY 1),
x AS (SELECT q, 0.5 * f1 + 0.25 * f2 + 0.15 * f3 + 0.1 * f4 AS score FROM f)
SELECT q AS media_id, round(score, 4) AS score, CASE WHEN score >= 0.8 THEN 'keep' WHEN score >= 0.6 THEN 'review' WHEN score >= 0.3 THEN 'weak' ELSE 'skip' END AS decision FROM x""")
def media_score(spark, d):
    v = t.vectors(spark, d)
    k = vec.neighbours(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), v.select("id", "vector"), 10)
    k = k.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    same, s, zero = F.col("label") == F.col("own"), F.col("similarity"), F.lit(0.0)
    f = k.groupBy("query_id").agg(F.greatest(zero, F.max(s)).alias("a"), F.greatest(zero, F.coalesce(F.max(F.when(same, s)), zero)).alias("b"), F.greatest(zero, F.coalesce(F.avg(F.when(same, s)), zero)).alias("c"), (F.count_if(s >= 0.6) / F.count("*")).alias("e"))
    f = f.withColumn("score", 0.5 * F.col("a") + 0.25 * F.col("b") + 0.15 * F.col("c") + 0.1 * F.col("e"))
    return f.select(F.col("query_id").alias("media_id"), F.round("score", 4).alias("score"), F.when(F.col("score") >= 0.8, "keep").when(F.col("score") >= 0.6, "review").when(F.col("score") >= 0.3, "weak").otherwise("skip").alias("decision"))


# Evaluation ---------------------------------------------------------------------------------------------------------


@query(f"WITH {t.LABELLED}, s AS (SELECT least(greatest(floor(score * 10), 0), 9)::BIGINT AS bin, avg(score) AS s, avg(label) AS p, count(*) AS n FROM lb GROUP BY 1) SELECT r.range AS bin, round(coalesce(s, 0), 6) AS mean_score, round(coalesce(p, 0), 6) AS positive_rate, coalesce(n, 0) AS n FROM range(10) r LEFT JOIN s ON r.range = s.bin")
def reliability_curve(spark, d):
    return evaluate.reliability(t.labelled(spark, d))


@query(f"WITH {t.LABELLED}, s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM lb GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * below) / (sum(p) * sum(n)), 6) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM c")
def ranking_auc(spark, d):
    return evaluate.auc(t.labelled(spark, d))


@query(f"WITH {t.LABELLED} SELECT label, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS greatest, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS p75 FROM lb GROUP BY 1")
def score_distribution(spark, d):
    return evaluate.describe(t.labelled(spark, d), ["label"])


@query(f"WITH {t.LABELLED}, r AS (SELECT source, label, power(2, label) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY source ORDER BY label DESC, id) AS b FROM lb), s AS (SELECT source, sum(CASE WHEN a <= 10 THEN g / log2(a + 1) ELSE 0 END) AS x, sum(CASE WHEN b <= 10 THEN g / log2(b + 1) ELSE 0 END) AS y FROM r GROUP BY 1) SELECT source, round(CASE WHEN y > 0 THEN x / y ELSE 0 END, 6) AS ndcg FROM s")
def ndcg_by_source(spark, d):
    return evaluate.ndcg(t.labelled(spark, d).withColumn("relevance", F.col("label")), ["source"], 10)


def _judged(spark, d):
    return feedback.latest(feedback.effective(t.events(spark, d))).select(F.col("target_id").alias("id"), "rating", "source")


@query(f"WITH {t.EVENTS}, {t.CANDIDATES}, top AS (SELECT id FROM cand ORDER BY base DESC, id LIMIT 20) SELECT round((SELECT count(*) FROM top JOIN lat ON id = target_id WHERE rating = 'like') / (SELECT count(*) FROM lat WHERE rating = 'like'), 6) AS like_at_k, round((SELECT count(*) FROM top JOIN lat ON id = target_id WHERE rating = 'dislike') / 20, 6) AS dislike_at_k")
def metrics_at_20(spark, d):
    return evaluate.at_top(t.candidates(spark, d).select("id", F.col("base").alias("score")), _judged(spark, d))


@query(f"WITH {t.EVENTS}, {t.CANDIDATES}, r AS (SELECT id, row_number() OVER (ORDER BY base DESC, id) AS r1, row_number() OVER (ORDER BY (id * 37 % 101)::DOUBLE / 101 DESC, id) AS r2 FROM cand) SELECT count(*) AS n, round(avg((r2 < r1)::INT), 6) AS win_rate FROM lat JOIN r ON id = target_id WHERE rating = 'like'")
def pairwise_win_rate(spark, d):
    rows = t.candidates(spark, d).select("id", "base", (F.col("id") * 37 % 101 / 101).alias("preference"))
    return evaluate.win_rate(rows, _judged(spark, d))


@query(f"WITH {t.CANDIDATES}, top AS (SELECT * FROM cand ORDER BY base DESC, id LIMIT 100) SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT key) AS scenarios FROM top")
def exploration_diversity(spark, d):
    return evaluate.exploration(t.candidates(spark, d).orderBy(F.desc("base"), "id").limit(100))


@query(f"WITH {t.EVENTS}, {t.CANDIDATES} SELECT count(*) AS judged, round(count(v.id) / count(*), 4) AS coverage, count(c.vector) AS scored, count(*) FILTER (c.vector IS NULL) AS base_only FROM lat LEFT JOIN vec v ON v.id = target_id LEFT JOIN cand c ON c.id = target_id")
def holdout_coverage(spark, d):
    c = t.candidates(spark, d)
    return evaluate.shares(_judged(spark, d), t.vectors(spark, d), c.select("id", F.when(F.col("vector").isNotNull(), F.col("base")).alias("final")))


@query(f"WITH {t.EVENTS}, a AS (SELECT DISTINCT source FROM lat WHERE target_id % 3 <> 0 AND source < 15), h AS (SELECT * FROM lat WHERE target_id % 3 = 0), b AS (SELECT DISTINCT source FROM h) SELECT (SELECT count(*) FROM a) AS train, (SELECT count(*) FROM b) AS holdout, (SELECT count(*) FROM a JOIN b USING (source)) AS shared, (SELECT count(*) FROM h WHERE source IN (SELECT source FROM a)) AS shared_rows")
def source_overlap(spark, d):
    j = _judged(spark, d)
    return evaluate.source_overlap(j.where("id % 3 <> 0 and source < 15"), j.where("id % 3 = 0"))


#: Pools: a point ends one if no chord over it runs below it.
_POOLS = f"""{t.LABELLED}, pt AS (SELECT score, count(*) AS c, sum(label)::BIGINT AS y FROM lb GROUP BY 1), cu AS (SELECT score, (sum(c) OVER w)::BIGINT AS k, (sum(y) OVER w)::BIGINT AS s FROM pt WINDOW w AS (ORDER BY score)),
al AS (SELECT k, s FROM cu UNION ALL SELECT 0, 0), up AS (SELECT b.k, max((b.s - a.s)::DOUBLE / (b.k - a.k)) AS m FROM cu b JOIN al a ON a.k < b.k GROUP BY 1), dn AS (SELECT b.k, min((a.s - b.s)::DOUBLE / (a.k - b.k)) AS m FROM cu b JOIN cu a ON a.k > b.k GROUP BY 1),
po AS (SELECT cu.score AS edge, cu.k, cu.s FROM cu JOIN up USING (k) LEFT JOIN dn USING (k) WHERE dn.m IS NULL OR up.m <= dn.m), st AS (SELECT edge, (s - lag(s, 1, 0) OVER (ORDER BY k))::DOUBLE / (k - lag(k, 1, 0) OVER (ORDER BY k)) AS value FROM po)"""


@query(f"WITH {_POOLS}, la AS (SELECT max(value) AS v FROM st) SELECT id, round(coalesce((SELECT min(value) FROM st WHERE edge >= lb.score), v), 6) AS probability FROM lb, la")
def calibrated_scores(spark, d):
    rows = t.labelled(spark, d)
    return evaluate.calibrated(rows, evaluate.calibrator(rows)).select("id", F.round("probability", 6).alias("probability"))


@query(f"""WITH {_POOLS}, b AS (SELECT least(greatest(floor(score * 10), 0), 9) AS bin, abs(round(avg(score), 6) - round(avg(label), 6)) AS gap FROM lb GROUP BY 1), f AS (SELECT avg(gap) AS off, max(gap) FILTER (bin = 5) AS middle FROM b),
g AS (SELECT (SELECT count(*) FROM lb) AS n, (SELECT count(*) FROM st) AS pools, (SELECT count(*) FROM pt) AS points, (SELECT max(score) - min(score) FROM lb) AS span, f.* FROM f), h AS (SELECT *, 1 - pools / points AS merged FROM g)
SELECT n, pools, round(merged, 6) AS merge_ratio, round(off, 6) AS miscalibration, CASE WHEN n < 10 THEN 'fixed-threshold (insufficient data for reliable calibration)' WHEN merged > 0.3 THEN 'monotonic-calibration' WHEN middle < 0.15 THEN 'fixed-threshold'
 WHEN span < 0.3 THEN 'percentile-threshold' WHEN off < 0.2 THEN 'fixed-threshold' ELSE 'monotonic-calibration' END AS advice FROM h""")
def calibration_advice(spark, d):
    return evaluate.strategy(t.labelled(spark, d))


# Frames, clips, timelines -------------------------------------------------------------------------------------------


@query(f"WITH {t.FRAMES}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 3600 AND score >= 0.1 AND lag(score) OVER w >= 0.1 THEN 0 ELSE 1 END AS x FROM fr WINDOW w AS (PARTITION BY video ORDER BY ts, frame)) SELECT video, frame, (sum(x) OVER (PARTITION BY video ORDER BY ts, frame ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM b")
def frame_islands(spark, d):
    return clips.islands(t.frames(spark, d), 3600, 0.1).select("video", "frame", "island")


@query()
def merged_clips(spark, d):
    return clips.clips(t.frames(spark, d), 3600, 0.1, 7200, 0.2).select("video", "start", "end", "frames", F.round("score", 6).alias("score"))


@query()
def temporally_distinct_clips(spark, d):
    return clips.temporal_dedup(t.frames(spark, d).select(F.col("frame").alias("id"), "video", F.col("ts").cast("double").alias("peak"), "score"), 7200.0).select("id", "video")


@query(f"WITH {t.FRAMES}, r AS (SELECT frame AS id, video, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame) AS rank, greatest(1, least(floor(count(*) OVER (PARTITION BY video) * 0.1::DOUBLE), 5))::BIGINT AS quota FROM fr) SELECT * FROM r WHERE rank <= quota")
def export_quota(spark, d):
    rows = clips.export_quota(t.frames(spark, d).withColumnRenamed("frame", "id"), 0.1, 5)
    return rows.select("id", "video", F.col("rank").cast("long").alias("rank"), F.col("quota").cast("long").alias("quota"))


@query(f"WITH {t.FRAMES}, c AS (SELECT CASE WHEN score < 0.3 THEN 0 WHEN score < 0.5 THEN 1 WHEN score < 0.7 THEN 2 WHEN score < 0.9 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM fr WHERE score BETWEEN 0 AND 1 GROUP BY 1) SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(5) r LEFT JOIN c ON r.range = c.bin")
def worthiness_histogram(spark, d):
    return clips.histogram(t.frames(spark, d))


@query(f"WITH {t.FRAMES}, v AS (SELECT video, max(ts) + 10 AS duration FROM fr GROUP BY 1), x AS (SELECT DISTINCT video, ts + unnest([-4, -2, 0, 2, 4]) AS ts FROM fr WHERE score >= 0.3) SELECT x.video, x.ts FROM x JOIN v USING (video) WHERE ts >= 0 AND ts <= duration - 1 AND (x.video, x.ts) NOT IN (SELECT (video, ts) FROM fr)")
def refinement_times(spark, d):
    f = t.frames(spark, d)
    return clips.refinement(f, f.groupBy("video").agg((F.max("ts") + 10).alias("duration")), 0.3, 4, 2)


@query("SELECT p_partkey AS video, unnest(range(0, p_size * 20 - 60, 20)) AS ts FROM part")
def sampling_grid(spark, d):
    return clips.sampling_grid(t.table(spark, d, "part").select(F.col("p_partkey").alias("video"), (F.col("p_size") * 20).alias("duration")), 20, 60)


@query(f"WITH {t.INTERVALS}, m AS (SELECT *, max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv WHERE e > s), c AS (SELECT video, sum(greatest(0, e - greatest(s, coalesce(p, s)))) AS c FROM m GROUP BY 1) SELECT v.video, round(least(1, coalesce(c, 0) / 3600), 6) AS coverage FROM (SELECT DISTINCT video FROM iv) v LEFT JOIN c USING (video)")
def temporal_coverage(spark, d):
    i = t.intervals(spark, d)
    return clips.coverage(i, i.select("video").distinct().withColumn("duration", F.lit(3600.0)))


@query(f"WITH {t.INTERVALS}, w AS (SELECT c_custkey AS window_id, c_custkey % 100 AS video, (c_custkey * 977 % 80000)::DOUBLE AS f, (c_custkey * 977 % 80000 + 3000)::DOUBLE AS t FROM customer) SELECT window_id, id FROM w JOIN iv ON w.video = iv.video AND s < t AND e > f")
def timeline_overlaps(spark, d):
    k = F.col("c_custkey")
    w = t.table(spark, d, "customer").select(k.alias("window_id"), (k % 100).cast("long").alias("video"), (k * 977 % 80000).cast("double").alias("from"), (k * 977 % 80000 + 3000).cast("double").alias("to"))
    return clips.overlaps(w, t.intervals(spark, d))


@query(f"WITH {t.INTERVALS}, k AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS o, CASE WHEN id % 4 <> 0 THEN id END AS thumb FROM iv), c AS (SELECT id, thumb, count(thumb) OVER (PARTITION BY video ORDER BY o, s, id ROWS UNBOUNDED PRECEDING) AS n FROM k) SELECT id, thumb IS NOT NULL AND n <= 10 AS shown FROM c")
def thumbnail_budget(spark, d):
    i = t.intervals(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "scene").otherwise("clip")).withColumn("thumb", F.when(F.col("id") % 4 != 0, F.col("id").cast("string")))
    return clips.thumbnails(i, 10).select("id", "shown")


@query(f"WITH {t.FRAMES}, r AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY ts, frame) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY video) // 12) AS step FROM fr) SELECT video, frame, rn FROM r WHERE rn % step = 0 AND rn / step < 12")
def stride_sample(spark, d):
    return review.even_stride(t.frames(spark, d), 12).select("video", "frame", F.col("rn").cast("long").alias("rn"))


# Catalog and duplicates ---------------------------------------------------------------------------------------------


@query(f"""WITH {t.HASHES}, p AS (SELECT bits, min(id) AS id FROM hs GROUP BY 1)
SELECT x.id AS a, y.id AS b, bit_count(xor(x.bits, y.bits))::BIGINT AS distance FROM p x JOIN p y ON x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= 5""")
def hamming_near_pairs(spark, d):
    return catalog.hamming_pairs(t.hashes(spark, d))


@query(f"""WITH RECURSIVE {t.HASHES}, p AS (SELECT bits, min(id) AS id FROM hs GROUP BY 1),
pr AS (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.id < y.id WHERE bit_count(xor(x.bits, y.bits)) <= 5),
q AS (SELECT b, list(a) AS l, row_number() OVER (ORDER BY b) AS n FROM pr GROUP BY 1),
st(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT q.n, CASE WHEN len(list_filter(q.l, lambda x: NOT list_contains(st.gone, x))) > 0 THEN list_append(st.gone, q.b) ELSE st.gone END FROM st JOIN q ON q.n = st.n + 1),
g AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM st ORDER BY n DESC LIMIT 1)),
m AS (SELECT b, min(a) AS leader FROM pr WHERE b IN (SELECT id FROM g) AND a NOT IN (SELECT id FROM g) GROUP BY 1)
SELECT hs.id, coalesce(m.leader, p.id) AS leader FROM hs JOIN p USING (bits) LEFT JOIN m ON m.b = p.id""")
def leader_clusters(spark, d):
    return catalog.leaders(t.hashes(spark, d))


@query("WITH m AS (SELECT p_brand AS cluster, p_partkey AS id, p_size AS frames FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY frames DESC, id) - 1 AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM m), s AS (SELECT *, least(3, greatest(2, n)) AS k, greatest(1, (n - 1) // (least(3, greatest(2, n)) - 1)) AS step FROM r) SELECT cluster, id, rn FROM s WHERE rn % step = 0 AND rn / step < k")
def cluster_representatives(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("id"), F.col("p_size").alias("frames"))
    return catalog.representatives(p).select("cluster", "id", F.col("rn").cast("long").alias("rn"))


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 23 <> 0 THEN p_brand END AS cluster, p_partkey % 3 = 0 AS rep, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS emotion, [p_name, p_brand || ' note', p_type] AS notes, p_name AS tag, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' seen' END AS summary, p_partkey % 5 <> 0 AS annotated FROM part),
k AS (SELECT * FROM m WHERE rep AND annotated AND cluster IS NOT NULL), c AS (SELECT cluster, emotion, count(*) AS n FROM k WHERE emotion IS NOT NULL GROUP BY 1, 2), e AS (SELECT cluster, arg_min(emotion, (-n, emotion)) AS emotion FROM c GROUP BY 1),
g AS (SELECT cluster, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(*) AS reps FROM k GROUP BY 1),
n1 AS (SELECT cluster, id, unnest(notes) AS note, generate_subscripts(notes, 1) AS pos FROM k), n2 AS (SELECT cluster, note, min(id * 10 + pos) AS place FROM n1 GROUP BY 1, 2), n3 AS (SELECT cluster, string_agg(note, ';' ORDER BY place) AS notes FROM (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY place) <= 4) GROUP BY 1),
u AS (SELECT cluster, string_agg(summary, ' | ' ORDER BY id) AS said FROM (SELECT * FROM k WHERE summary IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY id) <= 2) GROUP BY 1)
SELECT m.id, m.cluster, coalesce(e.emotion, 'unknown') AS emotion, g.tags, n3.notes, '[Inherited from cluster ' || m.cluster || '] ' || coalesce(u.said, 'Cluster ' || m.cluster) AS summary, g.reps
FROM m JOIN g ON m.cluster = g.cluster LEFT JOIN e ON e.cluster = m.cluster LEFT JOIN n3 ON n3.cluster = m.cluster LEFT JOIN u ON u.cluster = m.cluster WHERE NOT rep AND NOT annotated""")
def inherited_labels(spark, d):
    k = F.col("p_partkey")
    p = t.table(spark, d, "part").select(k.alias("id"), F.when(k % 23 != 0, F.col("p_brand")).alias("cluster"), (k % 3 == 0).alias("representative"), F.when(k % 4 != 0, F.col("p_type")).alias("emotion"), F.array("p_name", F.concat("p_brand", F.lit(" note")), "p_type").alias("notes"), F.array("p_name").alias("tags"), F.when(k % 6 == 0, F.concat("p_name", F.lit(" seen"))).alias("summary"))
    return catalog.inherit(p.where("id % 5 <> 0").drop("cluster", "representative"), p.select("id", "cluster", "representative")).withColumn("notes", F.array_join("notes", ";"))


def _outline(text):
    """Stands for a file by its lines but the middle one: files that differ there alone are probable moves."""
    lines = F.split(text, "\n")
    middle = F.floor(F.size(lines) / 2).cast("int")
    return F.sha2(F.array_join(F.concat(F.slice(lines, 1, middle), F.slice(lines, middle + 2, F.size(lines))), "\n"), 256)


def _scanned(spark, d):
    x = t.table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), _outline(F.col("text")).alias("fingerprint"))
    return x.where("doc_id % 2 = 0").withColumn("path", F.concat(F.lit("/old/"), "doc_id")).withColumn("id", F.col("doc_id")), x.where("doc_id % 2 = 1").withColumn("path", F.concat(F.lit("/new/"), "doc_id"))


@query("""WITH x AS (SELECT doc_id, sha256(text) AS h, sha256(array_to_string(list_concat(l[1 : len(l) // 2], l[len(l) // 2 + 2 :]), chr(10))) AS f FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)), c AS (SELECT * FROM x WHERE doc_id % 2 = 0), s AS (SELECT * FROM x WHERE doc_id % 2 = 1),
e AS (SELECT c.doc_id AS id, s.doc_id AS n, 'exact' AS kind FROM c JOIN s ON c.h = s.h), p AS (SELECT c.doc_id AS id, s.doc_id AS n, 'probable' AS kind FROM c JOIN s ON c.f = s.f AND c.h <> s.h WHERE c.doc_id NOT IN (SELECT id FROM e)), a AS (SELECT * FROM e UNION ALL SELECT * FROM p)
SELECT id, '/old/' || id AS old_path, '/new/' || n AS new_path, CASE WHEN count(*) OVER (PARTITION BY n) > 1 THEN 'conflict' ELSE kind END AS kind FROM a""")
def relink_proposals(spark, d):
    return catalog.relinks(*_scanned(spark, d))


@query()
def ingest_outcomes(spark, d):
    h = t.hashes(spark, d).withColumn("sha256", F.sha2(F.col("bits").cast("string"), 256)).withColumn("path", F.lpad(F.col("id").cast("string"), 12, "0"))
    return catalog.ingest(h.where("id % 5 = 0"), h.where("id % 5 <> 0")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id::VARCHAR) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    x = t.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha256"), F.lit(0).alias("created_at"))
    return lab.duplicates(x, "sha256").select("sha256", "n", "ids")


# Search and review --------------------------------------------------------------------------------------------------

_POSTINGS = "w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents), po AS (SELECT id, len(ws) AS length, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM w) GROUP BY id, len(ws), term)"


@query(f"WITH {_POSTINGS}, h AS (SELECT * FROM po WHERE term IN ('the', 'that')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1), k AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM w WHERE ws IS NOT NULL), s AS (SELECT id, count(*) AS c, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) AS x FROM h JOIN f USING (term), k GROUP BY 1) SELECT id, round(x / (1 + x), 6) AS score FROM s WHERE c = 2")
def text_search(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.text_scores(docs, ["the", "that"])


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM po GROUP BY 1")
def search_terms(spark, d):
    return search.postings(t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _library(spark, d):
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    return p.select(k.alias("id"), F.array(F.lower("p_name"), F.lit("all")).alias("tags"), F.concat(F.lit("/clips/"), "p_brand").alias("artifact_path"), F.lit(None).cast("string").alias("preview_path"), F.concat(F.lit("/video/"), "p_type").alias("source_video_path"), (k * 3 % 120).cast("double").alias("start_sec"), (k * 3 % 120 + 2.5 + k % 5 * 0.5).cast("double").alias("end_sec"), F.element_at(F.array(*map(F.lit, t.STATUSES)), (k % 4 + 1).cast("int")).alias("status"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + k * 60_000_000).alias("created_at"), F.when(k % 9 != 0, k * 31 % 97 / 97).alias("final_score"))


@query("SELECT p_partkey AS id FROM part WHERE lower(p_brand) LIKE '%brand#1%' AND p_partkey % 4 IN (0, 2) AND (2.5 + p_partkey % 5 * 0.5) BETWEEN 3 AND 4")
def filtered_search(spark, d):
    return _library(spark, d).where(search.filters(["all"], "BRAND#1", (3.0, 4.0), ["candidate", "liked"])).select("id")


@query("SELECT p_partkey AS id, round((p_partkey * 31 % 97)::DOUBLE / 97, 6) AS final_score FROM part WHERE p_partkey % 9 <> 0 ORDER BY p_partkey * 31 % 97 DESC, p_partkey DESC LIMIT 24")
def browse_page(spark, d):
    return search.browse(_library(spark, d), 24).select("id", F.round("final_score", 6).alias("final_score"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 24")
def keyset_page(spark, d):
    import datetime

    after = datetime.datetime.fromtimestamp(1_700_000_000 + 50 * 60, datetime.UTC)
    return search.page_after(_library(spark, d), (after, 50), 24).select("id")


@query("SELECT CASE WHEN p_partkey % 6 = 0 THEN 'favorited' ELSE ['candidate', 'promoted', 'liked', 'archived'][p_partkey % 4 + 1] END AS status, count(*) AS n FROM part GROUP BY 1")
def candidate_counts(spark, d):
    rows = _library(spark, d)
    return library.status_counts(rows, rows.where("id % 6 = 0"))


def _review(spark, d):
    c = t.candidates(spark, d)
    return c.select("id", "source", F.col("base").alias("score"), (F.col("id") * 53 % 101 / 101).alias("probability"), (F.col("id") * 29 % 89 / 89).alias("explore"))


_CHOSEN = """n AS (SELECT {key} AS q, least({limit}, count(*)) AS n FROM c GROUP BY 1), z AS (SELECT q, n, floor(n * 0.7::DOUBLE) AS n1, floor(n * 0.2::DOUBLE) AS n2 FROM n),
x1 AS (SELECT q, id, vector, label FROM c JOIN z ON z.q = {key} QUALIFY row_number() OVER (PARTITION BY q ORDER BY base DESC, id) <= any_value(n1) OVER (PARTITION BY q)),
x2 AS (SELECT q, id, vector, label FROM c JOIN z ON z.q = {key} WHERE id NOT IN (SELECT id FROM x1) QUALIFY row_number() OVER (PARTITION BY q ORDER BY abs(p - 0.5), id) <= any_value(n2) OVER (PARTITION BY q))"""


@query(f"""WITH {t.CANDIDATES}, c AS (SELECT id, id % 20 AS source, base, (id * 53 % 101)::DOUBLE / 101 AS p, (id * 29 % 89)::DOUBLE / 89 + id::DOUBLE / 1e9 AS explore, NULL AS vector, 0 AS label FROM cand), {_CHOSEN.format(key="0", limit=50)},
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY explore DESC) AS k FROM c WHERE id NOT IN (SELECT id FROM x1) AND id NOT IN (SELECT id FROM x2)), x3 AS (SELECT id FROM r, z QUALIFY row_number() OVER (ORDER BY k > 1, explore DESC) <= any_value(n - n1 - n2) OVER ())
SELECT id, 'exploit' AS bucket FROM x1 UNION ALL SELECT id, 'uncertain' FROM x2 UNION ALL SELECT id, 'explore' FROM x3""")
def review_queue(spark, d):
    return review.queue(_review(spark, d).withColumn("explore", F.col("explore") + F.col("id") / 1e9), 50)


@query(f"""WITH {t.CANDIDATES}, c AS (SELECT id, id % 20 AS source, base, (id * 53 % 101)::DOUBLE / 101 AS p, cand.vector, v.label FROM cand JOIN vec v USING (id) WHERE cand.vector IS NOT NULL AND id % 7 < 5 OR id < 20), {_CHOSEN.format(key="id % 7", limit=30)},
y AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2), el AS (SELECT q, label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM y WHERE vector IS NOT NULL),
o AS (SELECT q, label, list(x ORDER BY i) AS m FROM (SELECT q, label, i, avg(x) AS x FROM el GROUP BY 1, 2, 3) GROUP BY 1, 2), a AS (SELECT q, list(x ORDER BY i) AS m FROM (SELECT q, i, avg(x) AS x FROM el GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT c.id, c.id % 7 AS q, source, coalesce(list_distance(c.vector, coalesce(o.m, a.m)), 0) AS explore FROM c LEFT JOIN o ON o.q = c.id % 7 AND o.label = c.label LEFT JOIN a ON a.q = c.id % 7 WHERE c.id NOT IN (SELECT id FROM y)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY explore DESC, id) AS k FROM r), x3 AS (SELECT r2.q, id FROM r2 JOIN z USING (q) QUALIFY row_number() OVER (PARTITION BY r2.q ORDER BY k > 1, explore DESC, id) <= any_value(n - n1 - n2) OVER (PARTITION BY r2.q))
SELECT q AS reviewer, id, 'exploit' AS bucket FROM x1 UNION ALL SELECT q, id, 'uncertain' FROM x2 UNION ALL SELECT q, id, 'explore' FROM x3""")
def reviewer_queues(spark, d):
    """A queue for each of seven reviewers, two of whom have fewer rows than the limit."""
    v = t.vectors(spark, d).select("id", F.col("label").alias("cluster"))
    c = t.candidates(spark, d).join(v, "id").where("vector is not null and id % 7 < 5 or id < 20")
    return review.queues(c.select((F.col("id") % 7).alias("reviewer"), "id", "source", F.col("base").alias("score"), (F.col("id") * 53 % 101 / 101).alias("probability"), "cluster", "vector"), "reviewer", 30)


@query()
def diverse_collection(spark, d):
    return review.farthest_first(t.candidates(spark, d).where("vector is not null").select("id", F.col("base").alias("score"), "vector"), 20)


@query()
def narrative_collections(spark, d):
    c = t.candidates(spark, d).where("vector is not null").select((F.col("id") % 10).alias("collection"), "id", "source", F.col("base").alias("quality"), (F.col("id") * 7 % 11 / 11).alias("preference"), "vector")
    beats = t.vectors(spark, d).where("id < 40").select((F.col("id") % 10).alias("collection"), F.expr("id div 10").alias("beat"), "vector")
    return review.narrative(c, beats)


def _near_rows(spark, d):
    return t.vectors(spark, d).select("id", (F.col("id") % 50).alias("grp"), (F.col("id") * 31 % 97 / 97).alias("score"), "vector")


@query()
def visually_distinct(spark, d):
    return review.greedy_near(_near_rows(spark, d), 0.3).select("id")


@query(f"WITH {t.VECTORS}, s AS (SELECT * FROM vec WHERE id % 7 = 0), e AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS p FROM s), a AS (SELECT list(x ORDER BY p) AS m FROM (SELECT p, avg(x) AS x FROM e GROUP BY 1)), o AS (SELECT label, list(x ORDER BY p) AS m FROM (SELECT label, p, avg(x) AS x FROM e GROUP BY 1, 2) GROUP BY 1) SELECT v.id, round(list_distance(v.vector, coalesce(o.m, a.m)), 6) AS explore FROM vec v LEFT JOIN o USING (label) CROSS JOIN a")
def explore_scores(spark, d):
    v = t.vectors(spark, d).select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("label").alias("cluster"))
    s = v.where("id % 7 = 0")
    return review.explore_scores(v, vec.weighted_mean(s, ["cluster"]), vec.weighted_mean(s.withColumn("one", F.lit(1)), ["one"]))


# Lab and reports ----------------------------------------------------------------------------------------------------


@query(f"WITH {t.STAGES} SELECT video_status, count(*) AS n FROM vs GROUP BY 1")
def video_statuses(spark, d):
    return lab.video_status(t.stages(spark, d)).groupBy("video_status").agg(F.count("*").alias("n"))


@query(f"WITH {t.STAGES} SELECT job, count(*) AS videos, CASE WHEN bool_and(video_status <> 'running') THEN CASE WHEN bool_or(video_status IN ('failed', 'needs_attention')) THEN 'needs_attention' ELSE 'succeeded' END ELSE 'running' END AS job_status FROM vs GROUP BY 1")
def job_statuses(spark, d):
    return lab.job_status(lab.video_status(t.stages(spark, d)))


@query(f"WITH {t.STAGES} SELECT job AS run, count(*) AS items, CASE WHEN bool_and(status = 'succeeded') THEN 'completed' WHEN bool_and(status = 'cancelled') THEN 'cancelled' WHEN bool_or(status = 'failed') THEN 'partial_failure' WHEN bool_or(status = 'running') THEN 'running' ELSE 'unknown' END AS run_status FROM st GROUP BY 1")
def run_statuses(spark, d):
    s = t.stages(spark, d)
    return lab.run_status(s.select(F.col("job").alias("run"), F.when(F.col("status") == "succeeded", "completed").otherwise(F.col("status")).alias("status")))


@query("SELECT (l_suppkey % 7)::VARCHAR AS config, CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag END AS run, l_linestatus AS metric, CASE WHEN grouping(l_returnflag) = 1 THEN 'config' ELSE 'run' END AS grain, round(avg(l_quantity::DOUBLE), 4) AS mean, round(min(l_quantity::DOUBLE), 4) AS least, round(max(l_quantity::DOUBLE), 4) AS greatest, count(*) AS n FROM lineitem GROUP BY GROUPING SETS (((l_suppkey % 7)::VARCHAR, l_returnflag, l_linestatus), ((l_suppkey % 7)::VARCHAR, l_linestatus))")
def scorecard(spark, d):
    li = t.table(spark, d, "lineitem")
    return lab.scorecard(li.select((F.col("l_suppkey") % 7).cast("string").alias("config"), F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").cast("double").alias("value")))


@query("WITH r AS (SELECT p_brand AS f, p_partkey AS a, lead(p_partkey) OVER w AS b, row_number() OVER w - 1 AS rn FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)), p AS (SELECT * FROM r WHERE rn % 2 = 0 AND b IS NOT NULL) SELECT f AS fingerprint, row_number() OVER (ORDER BY f, rn) - 1 AS pair_index, a, b FROM p")
def ab_pairs(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_brand").alias("fingerprint"), F.col("p_partkey").alias("item"))
    return lab.pairing(p).select("fingerprint", "pair_index", "a", "b")


@query("WITH p AS (SELECT o_custkey % 40 AS session, o_orderkey AS pair_index, o_orderkey % 2 = 0 AS l, CASE WHEN o_custkey % 40 = 7 AND o_orderkey % 5 = 0 THEN NULL ELSE ['left', 'right', 'tie', 'both_bad'][o_orderkey * 13 % 4 + 1] END AS c FROM orders) SELECT session, count(*) AS pairs, count(c) AS judged, count(*) FILTER ((c = 'left' AND l) OR (c = 'right' AND NOT l)) AS wins_a, count(*) FILTER ((c = 'right' AND l) OR (c = 'left' AND NOT l)) AS wins_b, count(*) FILTER (c = 'tie') AS ties, count(*) FILTER (c = 'both_bad') AS both_bad FROM p GROUP BY 1 HAVING count(c) = count(*)")
def ab_results(spark, d):
    o, k = t.table(spark, d, "orders"), F.col("o_orderkey")
    pairs = o.select((F.col("o_custkey") % 40).alias("session"), k.alias("pair_index"), (k % 2 == 0).alias("left_is_a"))
    choices = F.element_at(F.array(*map(F.lit, ["left", "right", "tie", "both_bad"])), (k * 13 % 4 + 1).cast("int"))
    judged = o.where(~((F.col("o_custkey") % 40 == 7) & (k % 5 == 0))).select((F.col("o_custkey") % 40).alias("session"), k.alias("pair_index"), choices.alias("choice"))
    return lab.reveal(pairs, judged)


@query()
def split_counts(spark, d):
    p = t.table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("fingerprint"), F.col("p_partkey").alias("item"))
    return lab.split(p).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints"))


@query("SELECT o_orderkey AS id, o_custkey % 100 AS slot, o_orderstatus AS config, lag(o_orderstatus) OVER w AS previous, lead(o_orderkey) OVER w IS NULL AS current FROM orders WINDOW w AS (PARTITION BY o_custkey % 100 ORDER BY o_orderdate, o_orderkey)")
def champion_history(spark, d):
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("slot"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("config"))
    return lab.history(o).select("id", "slot", "config", "previous", "current")


@query("WITH c AS (SELECT s_nationkey AS c, count(*) AS v, bool_or(s_suppkey % 10 = 0) AS f FROM supplier GROUP BY 1), r AS (SELECT c_nationkey AS c, c_custkey AS id, c_acctbal AS s FROM customer) SELECT r.c AS collection, (coalesce(v, 0) + 1)::BIGINT AS version, row_number() OVER (PARTITION BY r.c ORDER BY s DESC, id) AS rank, id FROM r LEFT JOIN c ON r.c = c.c WHERE f IS NULL OR NOT f")
def collection_versions(spark, d):
    s, c = t.table(spark, d, "supplier"), t.table(spark, d, "customer")
    current = s.select(F.col("s_nationkey").alias("collection"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("version"), (F.col("s_suppkey") % 10 == 0).alias("frozen"))
    return lab.next_versions(current, c.select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")))


@query("""WITH a AS (SELECT 'job' AS kind, o_orderkey::VARCHAR AS key, 'error' AS severity, 'order ' || o_orderkey AS title FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'stage', event_id::VARCHAR, 'warning', 'event ' || event_id FROM events WHERE event_type = 'error' UNION ALL SELECT 'publish', p_partkey::VARCHAR, 'info', 'part ' || p_partkey FROM part WHERE p_size > 45)
SELECT 'att_' || substr(sha256(kind || ':' || key), 1, 16) AS id, kind, severity, title FROM a""")
def attention_inbox(spark, d):
    shape = lambda df, kind, key, severity, word: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.lit(severity).alias("severity"), F.concat(F.lit(word), F.col(key).cast("string")).alias("title"), F.col(key).cast("long").alias("created_at"))
    return lab.inbox(shape(t.table(spark, d, "orders").where("o_orderstatus = 'P'"), "job", "o_orderkey", "error", "order "), shape(t.table(spark, d, "events").where("event_type = 'error'"), "stage", "event_id", "warning", "event "), shape(t.table(spark, d, "part").where("p_size > 45"), "publish", "p_partkey", "info", "part ")).select("id", "kind", "severity", "title")


@query("""WITH s AS (SELECT o_orderkey AS clip, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status FROM orders), f AS (SELECT l_orderkey AS clip, count(*) AS n, min((l_suppkey % 7)::VARCHAR) AS h FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), m AS (SELECT l_orderkey AS clip, count(*) AS n, min((l_suppkey % 7)::VARCHAR) AS h FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 9 <> 0 GROUP BY 1),
r AS (SELECT s.clip, CASE WHEN status <> 'succeeded' THEN 'open' WHEN coalesce(f.n, 0) <> 1 THEN 'files' WHEN coalesce(m.n, 0) <> 1 THEN 'manifest' WHEN f.h <> m.h THEN 'digest' END AS fault FROM s LEFT JOIN f ON s.clip = f.clip LEFT JOIN m ON s.clip = m.clip) SELECT * FROM r WHERE fault IS NOT NULL""")
def fanout_audit(spark, d):
    o, li = t.table(spark, d, "orders"), t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), (F.col("l_suppkey") % 7).cast("string").alias("sha256"), "l_linenumber")
    s = o.select(F.col("o_orderkey").alias("clip"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"))
    return lab.audit(s, li.where("l_linenumber <= 2"), li.where("l_linenumber = 1 and clip % 9 <> 0"))


@query("WITH x AS (SELECT event_id % 900 AS id, event_type AS v FROM events), i AS (SELECT id, min(v) AS v FROM x GROUP BY 1), e AS (SELECT * FROM i WHERE id % 2 = 0), n AS (SELECT id, v FROM i WHERE id % 3 = 0) SELECT id, v FROM n WHERE id NOT IN (SELECT id FROM e)")
def idempotent_append(spark, d):
    rows = t.table(spark, d, "events").groupBy((F.col("event_id") % 900).alias("id")).agg(F.min("event_type").alias("v"))
    return files.append_new(rows.where("id % 2 = 0"), rows.where("id % 3 = 0"), "id", ["id", "v"])[0]


def digest_sql(rows: str, fields: list[str]) -> str:
    """SQL for ``digests``: a row ``(digest, n)`` over ``rows``."""
    cells = " || ".join(f"coalesce(length({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)
    sums = " || ',' || ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(8))
    return f"SELECT sha256(count(*)::VARCHAR || ',' || {sums}) AS digest, count(*) AS n FROM (SELECT sha256({cells}) AS h FROM {rows})"


@query(f"WITH i AS (SELECT p_brand AS fingerprint, p_partkey AS item FROM part), g AS ({digest_sql('i', ['fingerprint', 'item'])}) SELECT sha256('1|' || digest) AS manifest_id, n AS items, (n - (SELECT count(DISTINCT fingerprint) FROM i))::BIGINT AS repeated FROM g")
def frozen_manifest(spark, d):
    return files.freeze(t.table(spark, d, "part").select(F.col("p_brand").alias("fingerprint"), F.col("p_partkey").alias("item")))


@query(f"""WITH {t.EVENTS}, g AS ({digest_sql('(SELECT DISTINCT target_id FROM pro)', ['target_id'])})
SELECT 'profile_' || substr(sha256('model|64|' || (SELECT epoch_us(max(created_at)) FROM pro) || '|' || digest || '|{{}}'), 1, 16) AS profile_version FROM g""")
def profile_version(spark, d):
    return feedback.profile_version(feedback.profile_events(t.events(spark, d)), "model", 64, "{}")


# Quality and text ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark, d):
    return t.table(spark, d, "events").select("event_id", X.strict_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k long").k.alias("k"))


def _annotations(spark, d):
    """Annotations of documents: the whole text as caption, its lines as notes and the first of them as why."""
    n, lines = F.col("doc_id"), F.split("text", "\n")
    emotion = F.element_at(F.array(*map(F.lit, ["joy", "Awe|tension", "boredom", " Serenity "])), (n % 4 + 1).cast("int"))
    why, reason = F.element_at(lines, 1), F.concat(F.lit("seen in "), "source")
    rows = t.table(spark, d, "documents")
    return rows.select(n.alias("id"), F.col("text").alias("caption"), emotion.alias("emotion"), F.when(n % 5 != 0, lines).alias("notes"), why.alias("why"), F.array("lang").alias("tags"), (F.col("n_chars") / 4000).alias("worth"), reason.alias("reason"))


_BAD = "(trim({x}, k.ws) = '' OR len(list_filter(k.marks, lambda m: contains(lower({x}), m))) > 0)"
_CONSTANTS = "k AS (SELECT ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) AS ws, [" + ", ".join(f"'{p}'" for p in X.PLACEHOLDERS) + "] AS marks)"


@query(f"""WITH {_CONSTANTS}, a AS (SELECT doc_id AS id, trim(coalesce(text, ''), ws) AS c, trim(coalesce(string_split(text, chr(10))[1], ''), ws) AS y, ['joy', 'Awe|tension', 'boredom', 'Serenity'][doc_id % 4 + 1] AS e,
 CASE WHEN doc_id % 5 <> 0 AND text IS NOT NULL THEN list_transform(string_split(text, chr(10)), lambda x: trim(x, ws)) END AS n, n_chars / 4000 AS w FROM documents, k),
f AS (SELECT id, {_BAD.format(x='c')} AS bc, length(c) AS lc, {_BAD.format(x='y')} AS bw, length(y) AS lw, e, n IS NULL AS nn, coalesce(len(list_filter(n, lambda x: {_BAD.format(x='x')})), 0) AS bn,
 coalesce(len(list_filter(n, lambda x: length(x) < 8 AND NOT {_BAD.format(x='x')})), 0) AS sn, coalesce(len(list_filter(n, lambda x: length(x) >= 8 AND NOT {_BAD.format(x='x')})), 0) AS gn, w FROM a, k),
g AS (SELECT concat_ws('; ', CASE WHEN bc THEN 'caption placeholder' END, CASE WHEN NOT bc AND lc < 8 THEN 'caption short' END, CASE WHEN contains(e, '|') THEN 'several emotions' END, CASE WHEN e = 'boredom' THEN 'unknown emotion' END,
 CASE WHEN nn THEN 'no notes' END, CASE WHEN bn > 0 THEN 'note placeholder' END, CASE WHEN sn > 0 THEN 'note short' END, CASE WHEN gn < 2 THEN 'few notes' END, CASE WHEN bw THEN 'why placeholder' END,
 CASE WHEN NOT bw AND lw < 12 THEN 'why short' END, CASE WHEN w < 0 OR w > 1 THEN 'worth range' END) AS errors FROM f)
SELECT CASE WHEN errors = '' THEN 'passed' ELSE 'quality_failed' END AS status, errors, count(*) AS n FROM g GROUP BY 1, 2""")
def frame_quality_gate(spark, d):
    return quality.frame_gate(_annotations(spark, d)).groupBy("status", "errors").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id AS id, coalesce(length(trim(text)), 0) AS c, CASE WHEN doc_id % 5 <> 0 THEN coalesce(len(string_split(text, chr(10))), 0) ELSE 0 END AS n,
 coalesce(length(trim(string_split(text, chr(10))[1])), 0) AS y, n_chars / 4000 AS w, length(trim('seen in ' || source)) AS r, lang FROM documents),
e AS (SELECT id, concat_ws(';', CASE WHEN c < 8 THEN 'caption' END, CASE WHEN n NOT BETWEEN 2 AND 4 THEN 'notes' END, CASE WHEN y < 12 THEN 'why' END, CASE WHEN w IS NULL OR w NOT BETWEEN 0 AND 1 THEN 'worth' END,
 CASE WHEN coalesce(r, 0) < 8 THEN 'reason' END) AS errors FROM a)
SELECT id, errors, errors = '' AS ok FROM e""")
def media_quality_gate(spark, d):
    return quality.media_gate(_annotations(spark, d))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS label FROM documents")
def clip_labels(spark, d):
    return t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.label(F.col("text")).alias("label"))


@query("""SELECT p_partkey AS id, list_sort(list_distinct(['emotion:' || lower(p_type), 'scene:' || lower(p_brand), 'tag:' || lower(p_name), 'tag:' || lower(p_brand)])) AS keys FROM part""".replace("list_sort(list_distinct(", "array_to_string(list_sort(list_distinct(").replace("])) AS", "])), ',') AS"))
def scenario_keys(spark, d):
    p = t.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(X.scenario_keys(F.col("p_type"), F.col("p_brand"), F.array("p_name", "p_brand", F.lit(" "))), ",").alias("keys"))


@query("SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS start, (s_suppkey % 50 + 2.5)::DOUBLE AS \"end\" FROM supplier")
def clip_name_round_trip(spark, d):
    k = F.col("s_suppkey")
    name = X.clip_name(F.col("s_name"), k % 1000, (k % 50).cast("double"), k % 50 + 2.5)
    return t.table(spark, d, "supplier").select(k.alias("id"), X.clip_interval(name).alias("i")).select("id", "i.start", "i.end")


# Explanations and lineage -------------------------------------------------------------------------------------------


@query(f"""WITH {t.EVENTS}, a AS (SELECT source, event_id, target_id FROM eff WHERE supersedes_event_id IS NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at DESC, event_id DESC) = 1),
s AS (SELECT *, CASE rating WHEN 'like' THEN 'liked' WHEN 'dislike' THEN 'disliked' WHEN 'neutral' THEN 'reviewed' END AS x FROM ev),
r AS (SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'candidate') AS status FROM s)
SELECT a.source, a.event_id, a.target_id, r.status FROM a JOIN r ON a.event_id = r.event_id""")
def undo_last(spark, d):
    return feedback.undo_last(t.events(spark, d), ("source",)).select("source", "event_id", "target_id", "status")


@query("SELECT doc_id AS id, array_to_string(list_filter(list_transform(string_split(concat_ws(' , ', lang, '', source, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM documents")
def tag_lists(spark, d):
    text = F.concat_ws(" , ", "lang", F.lit(""), "source", F.lit(""))
    return t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(feedback.tag_list(text), "|").alias("tags"))


@query(f"""WITH {t.STAGES}, s AS (SELECT video, stage, max(status) AS stage_status FROM st GROUP BY 1, 2),
a AS (SELECT (l_orderkey * 10 + l_linenumber % 2)::BIGINT AS video, 'gif_clip' AS stage, count(*) AS n FROM lineitem WHERE l_linenumber > 4 AND l_quantity > 20 GROUP BY 1)
SELECT o_orderkey AS id, o_orderkey AS job, o_orderstatus AS job_status, (o_orderkey * 10 + 1)::BIGINT AS video, s.stage, s.stage_status, coalesce(n, 0) AS artifacts
FROM orders LEFT JOIN s ON s.video = o_orderkey * 10 + 1 LEFT JOIN a ON a.video = s.video AND a.stage = s.stage""")
def provenance_trail(spark, d):
    o, li = t.table(spark, d, "orders"), t.table(spark, d, "lineitem").where("l_linenumber > 4 and l_quantity > 20")
    key = F.col("o_orderkey")
    made = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).cast("long").alias("video"), F.lit("gif_clip").alias("stage"))
    return lineage.provenance(o.select(key.alias("id"), key.alias("job"), (key * 10 + 1).cast("long").alias("video")), o.select(key.alias("job"), F.col("o_orderstatus").alias("status")), t.stages(spark, d), made)


@query(f"WITH {t.FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ts, frame) AS rn FROM fr) SELECT video, count(*) AS n, string_agg(frame::VARCHAR, ',' ORDER BY rn) AS frames FROM r WHERE rn <= 8 GROUP BY 1")
def synthesis_frames(spark, d):
    return lineage.synthesis_frames(t.frames(spark, d)).select("video", "n", F.array_join(F.transform("frames", lambda x: x.frame.cast("string")), ",").alias("frames"))


@query("WITH m AS (SELECT p_partkey % 7 = 0 AS r, p_partkey % 4 = 1 AS g, p_size > 20 AS a FROM part) SELECT count(*) FILTER (r) AS total, count(*) FILTER (r AND a) AS annotated, count(*) FILTER (r AND NOT a) AS remaining, round(count(*) FILTER (g AND a) / count(*) FILTER (g), 4) AS gif_share FROM m")
def representative_coverage(spark, d):
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    media = p.select(k.alias("id"), (k % 7 == 0).alias("is_representative"), F.when(k % 4 == 1, "gif").otherwise("video").alias("media_type"))
    return lineage.representative_coverage(media, p.where("p_size > 20").select(k.alias("id")))


@query(f"""WITH rr AS ({ORACLE_SQL["feedback_rerank"]}), {t.EVENTS}, {t.VECTORS},
s AS (SELECT q.id AS q, i.id, round({_COS.format(a='q.vector', b='i.vector')}, 6) AS s FROM vec q JOIN vec i ON q.id <> i.id WHERE q.id % 50 = 0 AND i.id IN (SELECT target_id FROM pro WHERE rating <> 'dislike')),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, id) <= 5), n AS (SELECT q, string_agg(id::VARCHAR, ',' ORDER BY s DESC, id) AS nearest FROM k GROUP BY 1)
SELECT rr.id, rr.base, coalesce(rr.global_like, 0) AS global_like, coalesce(rr.scenario_like, 0) AS scenario_like, coalesce(rr.dislike, 0) AS dislike, rr.final_score, coalesce(n.nearest, '') AS nearest FROM rr LEFT JOIN n ON rr.id = n.q WHERE rr.id % 50 = 0""")
def ranking_explanations(spark, d):
    liked = feedback.profile_events(t.events(spark, d)).where("rating <> 'dislike'").select(F.col("target_id").alias("id"))
    return explain.ranking_explanation(feedback_rerank(spark, d).where("id % 50 = 0"), liked, t.vectors(spark, d).select("id", "vector"))


@query(f"""WITH {t.CANDIDATES}, x AS (SELECT id, base, CASE WHEN id % 9 <> 0 THEN (id * 31 % 97)::DOUBLE / 97 END AS final, id % 5 AS run, source FROM cand)
SELECT id, CASE WHEN final IS NULL THEN 1 ELSE 2 END AS n, 'Selected with ' || concat_ws('; ', printf('base=%.2f', base), printf('final=%.2f', final)) || ' (run ' || run || ', source ' || source || ')' AS sentence FROM x""")
def selection_explanations(spark, d):
    rows = t.candidates(spark, d).select("id", "base", F.when(F.col("id") % 9 != 0, F.col("id") * 31 % 97 / 97).alias("final"), (F.col("id") % 5).alias("run"), "source")
    return explain.selection_explanation(rows, ["base", "final"], ["run", "source"]).select("id", F.size("components").alias("n"), "sentence")


@query(f"""WITH {t.VECTORS}, s AS (SELECT q.id AS query_id, i.id, i.label, round({_COS.format(a='q.vector', b='i.vector')}, 6) AS s FROM vec q JOIN vec i ON q.id <> i.id WHERE q.id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 3)
SELECT query_id, string_agg(id || ':emotion ' || label || ':a' || id % 3 || '+b' || id % 5 || '+c', '|' ORDER BY rank) AS context FROM k GROUP BY 1""")
def retrieval_contexts(spark, d):
    v = t.vectors(spark, d)
    tag = lambda s, n: F.concat(F.lit(s), (F.col("id") % n).cast("string"))
    labels = v.select("id", F.concat(F.lit("emotion "), F.col("label").cast("string")).alias("emotion"), F.array(tag("a", 3), tag("b", 5), F.lit("c"), F.lit("d")).alias("tags"))
    rows = explain.retrieval_context(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), v.select("id", "vector"), labels)
    return rows.select("query_id", F.array_join(F.transform("context", lambda x: F.concat_ws(":", x.id.cast("string"), x.emotion, F.array_join(x.tags, "+"))), "|").alias("context"))


@query()
def taste_map(spark, d):
    return explain.taste_map(t.vectors(spark, d)).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
