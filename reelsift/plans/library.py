"""Queries of the media library over the driver's tables; they join those of the registry."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.functions import columns as X
from reelsift.operators import evaluate, explain, lab, library, review, search
from reelsift.operators import vectors as vec
from reelsift.operators.greedy import shared_folder
from reelsift.operators.text_index import TextIndex
from reelsift.plans import registry as r
from reelsift.plans import tables as t
from reelsift.sources import files

# Joins and counts ---------------------------------------------------------------------------------------------------


@r.query("SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 4 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def neighbour_details(spark, d):
    c, n, g = (t.table(spark, d, x) for x in ("customer", "nation", "region"))
    known = n.where("n_nationkey % 4 <> 0").join(F.broadcast(g), n.n_regionkey == g.r_regionkey, "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    return library.with_details(c.select(F.col("c_nationkey").alias("id"), "c_custkey"), known).select(F.col("c_custkey").alias("id"), "nation", "region")


@r.query("SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT event_id % 5000 FROM events)")
def annotated_with_frames(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return library.having(docs, t.table(spark, d, "labels").select(F.col("doc_id").alias("id")), t.table(spark, d, "events").select((F.col("event_id") % 5000).alias("id")))


@r.query("SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def unindexed_media(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return library.lacking(docs, t.table(spark, d, "labels").select(F.col("doc_id").alias("id")), t.table(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id")))


@r.query(f"WITH {t.EVENTS}, {t.CANDIDATES} SELECT id, base FROM cand WHERE id IN (SELECT target_id FROM ev WHERE undone_at IS NULL AND rating IN ('like', 'dislike'))")
def feedback_candidates(spark, d):
    rated = t.events(spark, d).where("undone_at is null and rating in ('like', 'dislike')").select(F.col("target_id").alias("id"))
    return library.having(t.candidates(spark, d), rated).select("id", "base")


@r.query(f"WITH {t.EVENTS} SELECT rating, count(*) AS orphans FROM ev WHERE target_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1")
def orphan_targets(spark, d):
    candidates = t.table(spark, d, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"))
    return library.lacking(t.events(spark, d).withColumnRenamed("target_id", "id"), candidates).groupBy("rating").agg(F.count("*").alias("orphans"))


@r.query("WITH c AS (SELECT s_suppkey AS collection, s_suppkey % 3 + 1 AS v FROM supplier), m AS (SELECT l_suppkey AS collection, l_linenumber AS v, l_orderkey AS id FROM lineitem) SELECT c.collection, c.v AS current_version, m.id FROM c LEFT JOIN m ON c.collection = m.collection AND c.v = m.v")
def current_collection_members(spark, d):
    c = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("collection"), (F.col("s_suppkey") % 3 + 1).alias("current_version"))
    m = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("collection"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_orderkey").alias("id"))
    return library.current_members(c, m)


@r.query(f"WITH {t.CANDIDATES} SELECT p_partkey AS id, round(coalesce(list_sum(vector), 0), 5) AS total, 64 AS size FROM part LEFT JOIN cand ON p_partkey = cand.id")
def candidate_vectors_or_zero(spark, d):
    rows = library.with_vector(t.table(spark, d, "part").select(F.col("p_partkey").alias("id")), t.candidates(spark, d).select("id", F.col("vector").cast("array<double>").alias("vector")), 64)
    return rows.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("vector").alias("size"))


@r.query("SELECT (SELECT count(*) FROM documents) AS media, (SELECT count(*) FROM events) AS frames, (SELECT count(*) FROM events WHERE event_type = 'view') AS pending, (SELECT count(*) FROM labels) AS annotated, (SELECT count(*) FROM embeddings) AS vectors")
def library_counts(spark, d):
    e = t.table(spark, d, "events")
    return library.library_counts(media=t.table(spark, d, "documents"), frames=e, pending=e.where("event_type = 'view'"), annotated=t.table(spark, d, "labels"), vectors=t.table(spark, d, "embeddings"))


@r.query("""WITH i AS (SELECT vec_id AS id FROM embeddings), m AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 40 <> 0), f AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 30 <> 1), x AS (SELECT (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM m) AS mapped, (SELECT count(*) FROM f) AS referenced, (SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM f)) AS unreferenced)
SELECT *, indexed = mapped AND mapped = referenced AND unreferenced = 0 AS consistent FROM x""")
def index_consistency(spark, d):
    v = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return library.index_consistency(v, v.where("id % 40 <> 0"), v.where("id % 30 <> 1"))


@r.query(f"WITH {t.STAGES} SELECT o_orderkey AS job, count(DISTINCT video) AS videos, count(st.job) AS stages, count(*) FILTER (stage = 'gif_clip') AS clips FROM orders LEFT JOIN st ON o_orderkey = st.job GROUP BY 1")
def job_summaries(spark, d):
    jobs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"))
    return library.job_summary(jobs, t.stages(spark, d).withColumn("clip", F.when(F.col("stage") == "gif_clip", F.col("video"))))


@r.query("SELECT o.outcome, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('retry')) o(outcome) LEFT JOIN events e ON e.event_type = o.outcome GROUP BY 1")
def outcome_report(spark, d):
    return library.outcome_report(t.table(spark, d, "events").select(F.col("event_type").alias("outcome")), ["click", "error", "purchase", "retry"])


# Listings -----------------------------------------------------------------------------------------------------------

_LIB = """lib AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'favorited' ELSE ['candidate', 'promoted', 'liked', 'archived'][p_partkey % 4 + 1] END AS shown,
 CASE WHEN p_partkey % 10 <> 0 THEN '/clips/' || p_brand || '/' || (p_size % 3) || '/' || p_partkey || '.gif' END AS artifact_path, p_partkey % 7 <> 0 AS exists,
 (p_partkey * 31 % 97)::DOUBLE / 97 AS final_score, ['candidate', 'promoted', 'liked', 'archived'][p_partkey % 4 + 1] AS status FROM part)"""


def _library(spark, d):
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    path = F.concat(F.lit("/clips/"), "p_brand", F.lit("/"), (F.col("p_size") % 3).cast("string"), F.lit("/"), k.cast("string"), F.lit(".gif"))
    status = F.element_at(F.array(*map(F.lit, t.STATUSES)), (k % 4 + 1).cast("int"))
    rows = p.select(k.alias("id"), status.alias("status"), F.when(k % 10 != 0, path).alias("artifact_path"), F.lit(None).cast("string").alias("preview_path"), (k % 7 != 0).alias("exists"), k.alias("created_at"), (k * 31 % 97 / 97).alias("final_score"))
    return rows, rows.where("id % 6 = 0").select("id")


_VIEWS = ["all", "candidate", "favorited", "liked", "promoted", "archived"]
_OF_VIEW = "(v = 'all' OR (v = 'candidate' AND status = 'candidate' AND NOT fav) OR (v = 'favorited' AND fav) OR (v NOT IN ('all', 'candidate', 'favorited') AND status = v))"
_ROWS = "rw AS (SELECT *, id % 6 = 0 AS fav FROM lib), vw AS (SELECT unnest(['all', 'candidate', 'favorited', 'liked', 'promoted', 'archived']) AS v)"


@r.query(f"WITH {_LIB}, {_ROWS} SELECT v AS view, id, CASE WHEN fav THEN 'favorited' ELSE status END AS shown, artifact_path AS path FROM rw, vw WHERE {_OF_VIEW}")
def candidate_list(spark, d):
    """Every status view, favorites in each that has them."""
    views = [library.candidate_list(*_library(spark, d), view).select(F.lit(view).alias("view"), "id", "shown", "path") for view in _VIEWS]
    return reduce(DataFrame.union, views)


@r.query(f"WITH {_LIB}, {_ROWS} SELECT id, CASE WHEN fav THEN 'favorited' ELSE status END AS shown FROM rw WHERE status = 'liked' AND id < 150 ORDER BY id DESC LIMIT 24")
def candidate_page(spark, d):
    return library.candidate_list(*_library(spark, d), "liked", after=(150, 150), size=24).select("id", "shown")


@r.query(f"WITH {_LIB} SELECT id, shown FROM lib WHERE artifact_path LIKE '/clips/Brand#13/%'")
def folder_candidates(spark, d):
    return library.candidate_list(*_library(spark, d), folder="/clips/Brand#13").select("id", "shown")


_FILES = """fi AS (SELECT artifact_path AS path FROM lib WHERE artifact_path IS NOT NULL AND id % 7 <> 0 UNION ALL SELECT '/clips/new/' || (p_size % 4) || '/' || p_partkey || '.GIF' FROM part WHERE p_partkey % 11 = 0
 UNION ALL SELECT '/clips/' || p_partkey || '.gif' FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT '/clips/' || p_partkey || '.txt' FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT '/other/' || p_partkey || '.gif' FROM part WHERE p_partkey % 13 = 1)"""


@r.query(f"""WITH {_LIB}, {_ROWS}, {_FILES}, fv AS (SELECT * FROM vw WHERE v IN ('all', 'candidate', 'liked')),
e AS (SELECT v, regexp_extract(artifact_path, '^(.*)/[^/]*$', 1) AS folder, CASE WHEN fav THEN 'favorited' ELSE status END AS shown, artifact_path NOT IN (SELECT path FROM fi) AS missing, false AS alone FROM rw, fv WHERE artifact_path IS NOT NULL AND {_OF_VIEW}
 UNION ALL SELECT v, regexp_extract(path, '^(.*)/[^/]*$', 1), 'candidate', false, true FROM fi, fv WHERE v IN ('all', 'candidate') AND lower(path) LIKE '%.gif' AND path NOT IN (SELECT artifact_path FROM lib WHERE artifact_path IS NOT NULL))
SELECT v AS view, CASE WHEN folder = '/clips' THEN '.' ELSE substr(folder, 8) END AS relative, count(*) AS n, count(*) FILTER (missing) AS missing, count(*) FILTER (alone) AS unmaterialized, count(*) FILTER (shown = 'candidate') AS candidate, count(*) FILTER (shown = 'liked') AS liked,
 count(*) FILTER (shown = 'favorited') AS favorited, CASE WHEN folder = '/clips' THEN 0 ELSE length(substr(folder, 8)) - length(replace(substr(folder, 8), '/', '')) END AS depth FROM e WHERE folder = '/clips' OR folder LIKE '/clips/%' GROUP BY v, folder""")
def folder_rollup(spark, d):
    rows, favorites = _library(spark, d)
    k, p = F.col("p_partkey"), t.table(spark, d, "part")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    files = rows.where("artifact_path is not null and exists").select(F.col("artifact_path").alias("path"))
    for rest, path in ((k % 11 == 0, text("/clips/new/", F.col("p_size") % 4, "/", k, ".GIF")), (k % 17 == 0, text("/clips/", k, ".gif")), (k % 13 == 0, text("/clips/", k, ".txt")), (k % 13 == 1, text("/other/", k, ".gif"))):
        files = files.union(p.where(rest).select(path))
    views = [library.folder_rollup(rows, favorites, files, "/clips/", ["candidate", "liked", "favorited"], view).withColumn("view", F.lit(view)) for view in ("all", "candidate", "liked")]
    return reduce(DataFrame.union, views).drop("folder")


@r.query("WITH p AS (SELECT s_suppkey AS version FROM supplier WHERE s_suppkey % 4 = 0 ORDER BY s_acctbal DESC, version DESC LIMIT 1) SELECT s_suppkey AS version, s_suppkey IN (SELECT version FROM p) AS current, s_nationkey % 2 = 0 AS publishable FROM supplier")
def profile_list(spark, d):
    s = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("version"), F.col("s_acctbal").alias("published_at"), F.col("s_suppkey").alias("created_at"), F.when(F.col("s_nationkey") % 2 == 0, "completed").otherwise("failed").alias("status"))
    return library.profile_list(s.drop("published_at"), s.where("version % 4 = 0").select("version", "published_at")).select("version", "current", "publishable")


@r.query("SELECT user_id AS phase, max(event_id) AS id, arg_max(event_type, event_id) AS state FROM events GROUP BY 1")
def latest_checkpoints(spark, d):
    return library.latest_checkpoints(t.table(spark, d, "events").select("event_id", F.col("user_id").alias("phase"), F.col("event_type").alias("state")).withColumnRenamed("event_id", "id"))


@r.query(f"WITH {_LIB} SELECT id, round(final_score, 6) AS final_score FROM lib WHERE status = 'candidate' AND final_score >= 0.7 ORDER BY lib.final_score DESC, id LIMIT 20")
def high_value_reviews(spark, d):
    return library.high_value(_library(spark, d)[0]).select("id", F.round("final_score", 6).alias("final_score"))


@r.query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY sha256('7:' || doc_id) LIMIT 5")
def unreviewed_picks(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return library.picks(library.lacking(docs, t.table(spark, d, "labels").select(F.col("doc_id").alias("id"))), 5, 7)


# Frames -------------------------------------------------------------------------------------------------------------


@r.query(f"WITH {t.FRAMES} SELECT video, count(*) FILTER (score > 0.2) AS kept, count(*) FILTER (NOT coalesce(score > 0.2, false)) AS dropped FROM fr GROUP BY 1")
def dark_frames(spark, d):
    return library.bright(t.frames(spark, d).withColumn("brightness", F.col("score")), 0.2)[1]


@r.query("SELECT p_partkey AS id, coalesce(p_size % 9 <> 0 AND p_partkey % 7 <> 0 AND p_size > 3 AND p_partkey % 2 = 0, false) AS exported FROM part WHERE p_partkey % 4 IN (1, 2) AND (p_partkey * 31 % 97)::DOUBLE / 97 >= 0.25")
def export_successes(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    media = t.table(spark, d, "part").withColumn("media_type", F.element_at(F.array(*map(F.lit, ["video", "gif", "image", "audio"])), (k % 4 + 1).cast("int"))).withColumn("score", k * 31 % 97 / 97)
    rows = library.worthy(library.scorable(media), 0.25)
    return rows.select(k.alias("id"), library.exported(size % 9 == 0, k % 7 != 0, size - 3, k % 2 == 0).alias("exported"))


@r.query("""WITH f AS (SELECT source, doc_id AS idx, len(replace(text, chr(10), '')) AS n FROM documents WHERE doc_id % 5 <> 0)
SELECT source, arg_max(idx, (n, -idx)) AS idx, max(n) AS size FROM f WHERE n > 0 GROUP BY 1""")
def best_frames(spark, d):
    rows = t.table(spark, d, "documents").select("source", F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 5 != 0, "seen").alias("caption"), F.split("text", "\n").alias("notes"))
    return library.best_frame(rows, ["source"])


@r.query("SELECT event_type AS emotion, count(*) AS n FROM events GROUP BY 1")
def emotion_shares(spark, d):
    return library.emotion_shares(t.table(spark, d, "events").select(F.col("event_type").alias("emotion")))


@r.query("""WITH g AS (SELECT p_brand AS b, p_type AS e, unnest(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT DISTINCT b, lower(w) AS w FROM g), x AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY w) AS n FROM k)
SELECT x.b AS brand, (SELECT string_agg(DISTINCT p_type, '|' ORDER BY p_type) FROM part WHERE p_brand = x.b) AS emotions, string_agg(w, '|' ORDER BY w) FILTER (n <= 20) AS tags FROM x GROUP BY 1""")
def neighbour_vocabulary(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("emotion"), F.split("p_name", " ").alias("tags"))
    return library.neighbour_vocabulary(rows, ["brand"]).select("brand", F.array_join("emotions", "|").alias("emotions"), F.array_join("tags", "|").alias("tags"))


_HASH = "('0x' || substr(sha256(coalesce(text, '')), 1, 16))::UBIGINT"


@r.query()
def diverse_frames(spark, d):
    h = t.hashes(spark, d)
    return library.diverse_frames(h.select((F.col("id") % 20).alias("video"), F.col("id").alias("frame"), (F.col("id") * 31 % 97 / 97).alias("score"), "bits"))


# Texts, ids, scores, moves ------------------------------------------------------------------------------------------


@r.query("""SELECT p_partkey AS id, trim(CASE WHEN p_partkey % 10 <> 0 THEN p_partkey || '.gif ' ELSE '' END || p_type || '.mp4 clip ' || printf('%.1f', (p_size * 10)::DOUBLE) || 's to ' || printf('%.1f', p_size * 10 + 2.5::DOUBLE) || 's ' || p_name || ' ' || p_brand || ' ' || p_type || ' tag:' || p_brand)
 AS text FROM part WHERE p_size * 10 < 1000""")
def candidate_texts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    summary = F.create_map(F.lit("reason"), F.col("p_brand"), F.lit("caption"), F.col("p_name"), F.lit("other"), F.lit("left out"))
    text = library.candidate_text(F.when(k % 10 != 0, F.concat(F.lit("/a/"), k.cast("string"), F.lit(".gif"))), F.lit(""), F.concat(F.lit("/v/"), "p_type", F.lit(".mp4")), (s * 10).cast("double"), s * 10 + F.lit(2.5), summary, F.array("p_type", F.lit(" ")), F.array(F.concat(F.lit("tag:"), "p_brand")), k)
    return t.table(spark, d, "part").where("p_size * 10 < 1000").select(k.alias("id"), text.alias("text"))


@r.query("SELECT doc_id AS id, concat_ws(' ', CASE WHEN text <> '' THEN text END, CASE WHEN doc_id % 3 <> 0 THEN 'awe' END, source, lang, source) AS text FROM documents")
def annotation_texts(spark, d):
    text = library.annotation_text(F.col("text"), F.when(F.col("doc_id") % 3 != 0, "awe"), F.col("source"), F.array("lang", "source", F.lit("")))
    return t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


@r.query("SELECT p_partkey AS id, substr(sha256(p_name || ':' || p_size || ':' || (p_size + 3) || ':' || p_partkey % 9), 1, 16) AS clip_id FROM part")
def clip_ids(spark, d):
    s = F.col("p_size")
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), library.clip_id(F.col("p_name"), s, s + 3, F.col("p_partkey") % 9).alias("clip_id"))


@r.query(f"""WITH f AS ({r.ORACLE_SQL["feedback_rerank"]}), c AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 = 0 AND vec_id % 11 <> 0), s AS (SELECT c.id, coalesce(CASE WHEN c.id % 3 <> 0 THEN final_score END, 0.5) AS x FROM c LEFT JOIN f USING (id))
SELECT id, x AS preference, least(greatest(x, 0.01), 0.99) AS probability FROM s""")
def review_scores(spark, d):
    v = t.vectors(spark, d)
    candidates = v.select("id", F.element_at(F.array(*map(F.lit, t.STATUSES)), (F.col("id") % 4 + 1).cast("int")).alias("status"))
    return library.review_scores(candidates, v.where("id % 11 <> 0"), r.feedback_rerank(spark, d).where("id % 3 <> 0"))


@r.query(f"WITH {t.CANDIDATES} SELECT id, round(CASE WHEN id % 5 = 0 THEN (id * 31 % 97)::DOUBLE / 97 ELSE base END, 6) AS score FROM cand")
def override_scores(spark, d):
    rows = t.candidates(spark, d).select("id", "base")
    return library.with_scores(rows, rows.where("id % 5 = 0").select("id", (F.col("id") * 31 % 97 / 97).alias("score"))).select("id", F.round("score", 6).alias("score"))


@r.query(f"""WITH h AS (SELECT doc_id AS id, {_HASH} AS b FROM documents), n AS (SELECT id, b FROM h UNION ALL SELECT id + 100000000, xor(b, CASE WHEN id % 60 < 60 THEN ((5::HUGEINT << (id % 60)::INT) % 18446744073709551616)::UBIGINT END) FROM h WHERE id % 3 = 0),
v AS (SELECT id, b, xor(b, (id % 4)::UBIGINT) AS c, (id % 1000)::DOUBLE / 10 AS duration FROM n WHERE id % 50 <> 7)
SELECT y.id AS video, min(x.id) AS duplicate_of FROM v x JOIN v y ON x.id < y.id AND abs(x.duration - y.duration) <= 2 AND bit_count(xor(x.b, y.b)) <= 5 AND bit_count(xor(x.c, y.c)) <= 5 GROUP BY 1""")
def fingerprint_duplicates(spark, d):
    h = t.hashes(spark, d).select("id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("one"), F.lower(F.lpad(F.hex(F.col("bits").bitwiseXOR(F.col("id") % 4)), 16, "0")).alias("two"))
    hashes = F.when(F.col("id") % 50 != 7, F.array("one", "two", "one")).otherwise(F.array(F.lit("bad"), "two", "one"))
    return library.fingerprint_duplicates(h.select(F.col("id").alias("video"), F.col("id").alias("position"), (F.col("id") % 1000 / 10).alias("duration"), hashes.alias("phashes")))


@r.query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'dry run' WHEN p_partkey % 4 = 0 THEN 'changed' WHEN p_partkey % 5 = 0 THEN 'claimed' ELSE 'applied' END AS outcome FROM part WHERE p_partkey % 2 = 0)
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS media_rows, CASE WHEN outcome = 'applied' THEN 2 ELSE 0 END AS candidate_paths FROM p""")
def relink_report(spark, d):
    return _relinked(spark, d)[2]


@r.query("SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN '/new/' || p_partkey ELSE '/old/' || p_partkey END AS source_video_path FROM part")
def relinked_candidates(spark, d):
    return _relinked(spark, d)[1].select("id", "source_video_path")


def _relinked(spark, d):
    p, k = t.table(spark, d, "part"), F.col("p_partkey")
    at = lambda top: F.concat(F.lit(f"/{top}/"), k.cast("string"))
    media = p.select(k.alias("id"), at("old").alias("path")).union(p.where("p_partkey % 10 = 0").select((k + 10_000_000).alias("id"), at("new").alias("path")))
    candidates = p.select(k.alias("id"), at("old").alias("source_video_path"), F.lit(None).cast("string").alias("artifact_path"), at("old").alias("preview_path"))
    proposals = p.where("p_partkey % 2 = 0").select(k.alias("id"), at("old").alias("old_path"), at("new").alias("new_path"), F.col("p_name").alias("digest"), (k % 3 == 0).alias("confirmed"))
    return library.apply_relinks(media, candidates, proposals, p.select(at("new").alias("path"), F.when(k % 4 != 0, F.col("p_name")).alias("digest")))


@r.query(f"""WITH m AS ({r.ORACLE_SQL["metrics_at_20"]}), w AS ({r.ORACLE_SQL["pairwise_win_rate"]}), o AS ({r.ORACLE_SQL["source_overlap"]}), {t.EVENTS}, j AS (SELECT count(*) AS judgments FROM lat WHERE target_id % 3 = 0)
SELECT judgments, o.shared AS shared_sources, concat_ws('; ', CASE WHEN judgments < 30 THEN 'too few judgments' END, CASE WHEN o.shared > 0 THEN 'sources overlap' END) AS reasons, judgments >= 30 AND o.shared = 0 AS ready, like_at_k, dislike_at_k, win_rate FROM j, m, w, o""")
def holdout_report(spark, d):
    judged = r._judged(spark, d)
    holdout = judged.where("id % 3 = 0")
    shared = evaluate.source_overlap(judged.where("id % 3 <> 0 and source < 15"), holdout)
    return library.holdout_report(holdout, [r.metrics_at_20(spark, d), r.pairwise_win_rate(spark, d).select("win_rate")], shared)


@r.query(f"""WITH {r._POSTINGS}, {t.VECTORS}, h AS (SELECT * FROM po WHERE term = 'the'), k AS (SELECT count(*) AS n, avg(len(ws)) AS m, (SELECT count(*) FROM h) AS df FROM w WHERE ws IS NOT NULL),
s AS (SELECT h.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m)) AS x FROM h, k),
q AS (SELECT vector AS q FROM vec WHERE id = 7), b AS (SELECT s.id, round(x / (1 + x), 6) AS score, CASE WHEN v.vector IS NOT NULL THEN greatest(0, least(1, {r._COS.format(a="v.vector", b="q.q")})) END AS near FROM s JOIN documents d ON d.doc_id = s.id AND d.lang = 'en' CROSS JOIN q LEFT JOIN vec v ON v.id = s.id),
f AS (SELECT id, round(CASE WHEN (SELECT count(near) FROM b) = 0 THEN score ELSE 0.5 * score + 0.5 * coalesce(near, 0) END, 6) AS score FROM b)
SELECT id, score, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 34 AS has_more FROM f ORDER BY score DESC, id LIMIT 24 OFFSET 10""")
def library_search(spark, d):
    """Filter, text and vector in one, a page of it."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    english = docs.where("lang = 'en'").select("id")
    v = t.vectors(spark, d).select("id", "vector")
    like = v.where("id = 7").first()
    scores = search.text_scores(docs, ["the"]).join(english, "id", "left_semi")
    found = search.blended(scores, v, [float(x) for x in like.vector]) if like else scores
    return search.paged(found, [F.desc("score"), F.col("id")], 24, 10)


_INDEXED = """dd AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'the that then ' || left(text, 200) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4),
w AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM dd), po AS (SELECT id, len(ws) AS length, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM w) GROUP BY id, len(ws), term)"""


@r.query(f"WITH {_INDEXED}, h AS (SELECT * FROM po WHERE term IN ('the', 'that')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1), k AS (SELECT count(*) AS n, avg(len(ws)) AS m FROM w WHERE ws IS NOT NULL), s AS (SELECT id, count(*) AS c, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))) AS x FROM h JOIN f USING (term), k GROUP BY 1) SELECT id, round(x / (1 + x), 6) AS score FROM s WHERE c = 2")
def indexed_search(spark, d):
    """Search served by an index that has come about in three increments: documents, changes of some, deletions of others."""
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("seq"))
    index = TextIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.add(docs, "a-documents")
    index.add(docs.where("id % 10 = 3").select("id", F.concat(F.lit("the that then "), F.substring("text", 1, 200)).alias("text"), F.lit(2).alias("seq")), "b-changes")
    index.add(docs.where("id % 10 = 4").select("id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("seq")), "c-deletions")
    return index.search(["the", "that"])


def _scored(spark, d):
    """Candidates with old scores, their vectors by model and dimension, and new scores."""
    c, k = t.candidates(spark, d), F.col("id")
    rows = c.select("id", F.element_at(F.array(*map(F.lit, t.STATUSES)), (k % 4 + 1).cast("int")).alias("status"), F.when(k % 19 != 0, F.col("base")).alias("base"), (k % 11 / 11).alias("final_score"), F.lit(None).cast("double").alias("profile_score"), F.lit("v1").alias("profile_version"))
    vectors = c.where("vector is not null").select("id", F.when(k % 5 != 0, "text").otherwise("image").alias("model"), F.size("vector").alias("dim"))
    return rows, vectors, c.select("id", F.round(F.col("base") * 0.5 + 0.1, 6).alias("final_score"), F.round(1 - F.col("base"), 6).alias("profile_score"))


@r.query(f"""WITH {t.CANDIDATES}, x AS (SELECT id, ['candidate', 'promoted', 'liked', 'archived'][id % 4 + 1] AS status, CASE WHEN id % 19 <> 0 THEN base END AS b, base, vector FROM cand), y AS (SELECT *, status = 'candidate' AND b IS NOT NULL AND vector IS NOT NULL AND id % 5 <> 0 AS fresh FROM x)
SELECT id, round(CASE WHEN fresh THEN round(base * 0.5 + 0.1, 6) ELSE (id % 11)::DOUBLE / 11 END, 6) AS final_score, CASE WHEN fresh THEN round(1 - base, 6) END AS profile_score, CASE WHEN fresh THEN 'v2' ELSE 'v1' END AS profile_version FROM y""")
def rescored_candidates(spark, d):
    """Written as a snapshot, rescored from it into the next one, and read."""
    rows, vectors, new = _scored(spark, d)
    path = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    files.write_snapshot(rows, path)
    files.write_snapshot(library.rescored(files.read_snapshot(spark, path), vectors, new, "text", 64, "v2"), path)
    return files.read_snapshot(spark, path).select("id", F.round("final_score", 6).alias("final_score"), "profile_score", "profile_version")


@r.query(f"""WITH {t.STAGES}, j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 97 = 0 THEN 'needs_attention' ELSE 'running' END AS status, o_orderdate AS created_at FROM orders), n AS (SELECT job, count(*) AS n FROM st WHERE status = 'failed' GROUP BY 1)
SELECT j.job, j.status, j.created_at, coalesce(n, 0) AS attention_count FROM j LEFT JOIN n ON n.job = j.job WHERE j.status = 'needs_attention' OR n IS NOT NULL""")
def job_attention(spark, d):
    jobs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 97 == 0, "needs_attention").otherwise("running").alias("status"), F.col("o_orderdate").alias("created_at"))
    stages = t.stages(spark, d).withColumn("status", F.when(F.col("status") == "failed", "needs_attention").otherwise(F.col("status")))
    return lab.attention(jobs, stages)


@r.query(f"""WITH {t.VECTORS}, tx AS (SELECT id, vector FROM vec WHERE id % 2 = 0), fe AS (SELECT id % 300 AS id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vec WHERE id % 3 = 1), fm AS (SELECT id, list(x ORDER BY i) AS m FROM (SELECT id, i, avg(x) AS x FROM fe GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN tx.id IS NOT NULL THEN 'text' WHEN fm.id IS NOT NULL THEN 'frames' END AS origin, round(list_sum(list_transform(coalesce(tx.vector, fm.m), lambda x, i: x * i)), 4) AS mark FROM part LEFT JOIN tx ON tx.id = p_partkey LEFT JOIN fm ON fm.id = p_partkey""")
def media_vectors(spark, d):
    v = t.vectors(spark, d)
    rows = vec.media_vectors(t.table(spark, d, "part").select(F.col("p_partkey").alias("id")), v.where("id % 2 = 0"), v.where("id % 3 = 1").select((F.col("id") % 300).alias("id"), "vector"))
    mark = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", "origin", F.round(mark, 4).alias("mark"))


@r.query(r"""WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '' END AS caption, CASE WHEN doc_id % 5 <> 0 THEN source || ' ' || lang END AS summary, CASE WHEN doc_id % 7 <> 0 THEN 'liked' END AS status FROM documents),
y AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN coalesce(caption, '') <> '' THEN caption ELSE coalesce(summary, '') END, '^\s+', ''), '\s+$', '') AS s FROM x)
SELECT id, CASE WHEN s = '' THEN 'Candidate ' || coalesce(status, 'candidate') WHEN length(s) > 60 THEN substr(s, 1, 57) || '...' ELSE s END AS label FROM y""")
def candidate_labels(spark, d):
    k = F.col("doc_id")
    return t.table(spark, d, "documents").select(k.alias("id"), X.caption_label(F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, ""), F.when(k % 5 != 0, F.concat("source", F.lit(" "), "lang")), F.when(k % 7 != 0, "liked")).alias("label"))


@r.query("""WITH x AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"message": "lost ' || event_type || '", "error": "x"}' WHEN 2 THEN ' {"error": "bad ' || user_id || '"}' WHEN 3 THEN repeat('long ', 60) || event_id WHEN 4 THEN '' END AS raw FROM events)
SELECT id, CASE WHEN coalesce(raw, '') = '' THEN 'No error details recorded.' WHEN id % 6 = 1 THEN json_extract_string(raw, '$.message') WHEN id % 6 = 2 THEN json_extract_string(trim(raw), '$.error')
 ELSE coalesce(CASE WHEN id % 6 = 0 THEN coalesce(json_extract_string(raw, '$.message'), json_extract_string(raw, '$.error')) END, left(trim(raw), 200)) END AS error FROM x""")
def readable_errors(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 6 == 0, F.col("props")).when(k % 6 == 1, F.concat(F.lit('{"message": "lost '), "event_type", F.lit('", "error": "x"}'))).when(k % 6 == 2, F.concat(F.lit(' {"error": "bad '), F.col("user_id").cast("string"), F.lit('"}'))).when(k % 6 == 3, F.concat(F.repeat(F.lit("long "), F.lit(60)), k.cast("string"))).when(k % 6 == 4, "")
    return t.table(spark, d, "events").select(k.alias("id"), X.readable_error(raw).alias("error"))


@r.query()
def collection_taste_maps(spark, d):
    v = t.vectors(spark, d).select("id", "label", "vector")
    return explain.taste_maps(v, "label").select("label", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@r.query()
def diverse_collections(spark, d):
    c = t.candidates(spark, d).select((F.col("id") % 100).alias("collection"), "id", F.col("base").alias("score"), "vector")
    return review.diverse_sets(c, "collection", 5)
