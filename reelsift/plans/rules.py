"""Queries of column rules, imports, sequential choices and streams over the driver's tables; they join those of the registry."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from reelsift.functions import columns as X
from reelsift.operators import clips, evaluate, lab, quality, search
from reelsift.operators.greedy import shared_folder
from reelsift.plans import registry as r
from reelsift.plans import runs  # noqa: F401  its queries come first
from reelsift.plans import tables as t
from reelsift.sources import files
from reelsift.streaming import jobs

# Column rules -------------------------------------------------------------------------------------------------------


@r.query("SELECT p_partkey AS id FROM part WHERE p_partkey BETWEEN 100 AND 900 AND p_partkey % 4 IN (0, 2)")
def dated_candidates(spark, d):
    """Made between two times, both included, with one of two statuses."""
    at = lambda minutes: F.lit(datetime.datetime.fromtimestamp(1_700_000_000 + 60 * minutes, datetime.UTC))
    return r._library(spark, d).where(search.filters(created=(at(100), at(900)), statuses=["candidate", "liked"])).select("id")


@r.query("""WITH x AS (SELECT p_partkey AS id, p_partkey % 19 = 0 AS broken, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN p_partkey % 7 = 0 THEN 'cut' ELSE 'export' END AS s, CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 2 END AS n, CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN 'a' ELSE 'b' END AS c FROM part)
SELECT id, CASE WHEN broken THEN 'unreadable' ELSE concat_ws('; ', CASE WHEN v <> 1 THEN 'version' END, CASE WHEN s <> 'export' THEN 'stage' END, CASE WHEN n <> 2 THEN 'count' END, CASE WHEN c = ' ' THEN 'empty id' END, CASE WHEN c = 'a' THEN 'repeated id' END) END AS errors FROM x""")
def manifest_errors(spark, d):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    raw = F.concat(F.lit('{"schema_version": '), text(F.when(k % 5 == 0, 2).otherwise(1)), F.lit(', "stage": "'), F.when(k % 7 == 0, "cut").otherwise("export"), F.lit('", "clip_count": '), text(F.when(k % 11 == 0, 3).otherwise(2)), F.lit(', "clips": [{"clip_id": "a"}, {"clip_id": "'), F.when(k % 13 == 0, " ").when(k % 17 == 0, "a").otherwise("b"), F.lit('"}]}'))
    rows = t.table(spark, d, "part").select(F.lit("export").alias("stage"), F.when(k % 19 == 0, F.concat(F.lit("{broken "), text(k))).otherwise(raw).alias("raw"), k.alias("id"))
    return quality.manifest_gate(rows, "schema_version int, stage string, clip_count int, clips array<struct<clip_id:string>>").select("id", "errors")


@r.query("SELECT o_orderkey AS id, CASE WHEN count(l_orderkey) <= 0 THEN 1.0::DOUBLE ELSE round(count(*) FILTER (l_returnflag <> 'R') / count(l_orderkey), 6) END AS integrity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 2 GROUP BY 1")
def export_integrity(spark, d):
    li = t.table(spark, d, "lineitem").where("l_linenumber > 2").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("s"))
    rows = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(li, "id", "left").na.fill(0, ["a", "s"])
    return rows.select("id", F.round(lab.integrity(F.col("a"), F.col("s")), 6).alias("integrity"))


@r.query(f"WITH {t.LABELLED}, v AS (SELECT source, id, score, id % 4 AS g FROM lb), r AS (SELECT source, g, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY source ORDER BY g DESC, id) AS b FROM v), s AS (SELECT source, sum(CASE WHEN a <= 5 THEN g / log2(a + 1) ELSE 0 END) AS x, sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS y FROM r GROUP BY 1) SELECT source, round(CASE WHEN y > 0 THEN x / y ELSE 0 END, 6) AS ndcg FROM s")
def linear_ndcg(spark, d):
    return evaluate.ndcg(t.labelled(spark, d).withColumn("relevance", F.col("id") % 4), ["source"], 5, linear=True)


@r.query("""WITH c AS (SELECT c_custkey AS config FROM customer), ru AS (SELECT o_custkey AS config, CASE WHEN o_orderkey % 2 = 0 THEN 'tune' ELSE 'holdout' END AS split, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'completed' END AS status FROM orders),
e AS (SELECT o_custkey AS config, avg(CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 1 END) AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY 1),
w AS (SELECT config, config IN (SELECT config FROM ru WHERE split = 'tune' AND status = 'completed') AS t, config IN (SELECT config FROM ru WHERE split = 'holdout' AND status = 'completed') AS h, config % 5 <> 0 AS s, coalesce(i, 1) AS i FROM c LEFT JOIN e USING (config))
SELECT config, concat_ws('; ', CASE WHEN NOT t THEN 'no tune run' END, CASE WHEN NOT h THEN 'no holdout run' END, CASE WHEN NOT s THEN 'no session' END, CASE WHEN i < 0.9 THEN 'exports incomplete' END) AS reasons, t AND h AND s AND i >= 0.9 AS promoted FROM w""")
def config_promotions(spark, d):
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("config"))
    o = t.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("config"), F.when(F.col("o_orderkey") % 2 == 0, "tune").otherwise("holdout").alias("split"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"))
    li = t.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0).alias("value"))
    return lab.promotion(c, o, c.where("config % 5 <> 0"), o.join(li, "o_orderkey").select("config", "value"))


@r.query(f"WITH {t.FRAMES}, a AS (SELECT video, ts // 600 AS ts, score, frame FROM fr WHERE frame % 2 = 0), b AS (SELECT video, ts // 600 AS ts, score + 0.01 AS score, frame FROM fr WHERE frame % 2 = 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT video, ts, frame, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY video, ts ORDER BY score DESC, frame DESC) = 1")
def united_frames(spark, d):
    f = t.frames(spark, d).withColumn("ts", F.floor(F.col("ts") / 600))
    both = clips.united(f.where("frame % 2 = 0"), f.where("frame % 2 = 1").withColumn("score", F.col("score") + 0.01))
    return both.select("video", "ts", "frame", F.round("score", 6).alias("score"))


@r.query("""WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '/v/' || p_name || '-ep01.mkv' WHEN 1 THEN 'C:\\v\\' || p_brand || '_' || p_partkey || '.mp4' WHEN 2 THEN '/v/' || p_partkey || '.' || p_size || '.avi' WHEN 3 THEN 'x-' || p_type WHEN 4 THEN '/a.b/' || p_type ELSE '/v/-' || p_partkey || '.gif' END AS path FROM part),
s AS (SELECT id, regexp_replace(regexp_extract(path, '[^/\\\\]*$'), '\\.[^.]*$', '') AS stem FROM p), h AS (SELECT *, trim(regexp_extract(stem, '^(.+?)[-_\\s.]+.*$', 1)) AS head FROM s)
SELECT id, CASE WHEN length(head) >= 2 AND NOT regexp_full_match(head, '[0-9]+') THEN head ELSE stem END AS film FROM h""")
def film_names(spark, d):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("/v/"), "p_name", F.lit("-ep01.mkv"))).when(k % 6 == 1, F.concat(F.lit("C:\\v\\"), "p_brand", F.lit("_"), text, F.lit(".mp4"))).when(k % 6 == 2, F.concat(F.lit("/v/"), text, F.lit("."), F.col("p_size").cast("string"), F.lit(".avi"))).when(k % 6 == 3, F.concat(F.lit("x-"), "p_type")).when(k % 6 == 4, F.concat(F.lit("/a.b/"), "p_type")).otherwise(F.concat(F.lit("/v/-"), text, F.lit(".gif")))
    return t.table(spark, d, "part").select(k.alias("id"), X.film_name(path).alias("film"))


@r.query("""WITH x AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN (value / 50)::VARCHAR WHEN 1 THEN 'Excellent shot' WHEN 2 THEN 'GOOD' WHEN 3 THEN 'about average' WHEN 4 THEN 'bad' WHEN 5 THEN 'NaN' END AS v FROM events)
SELECT id, round(CASE id % 7 WHEN 0 THEN greatest(0, least(1, v::DOUBLE)) WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 WHEN 4 THEN 0.15 ELSE 0.5 END, 6) AS worth FROM x""")
def worthiness_values(spark, d):
    k = F.col("event_id")
    value = F.when(k % 7 == 0, (F.col("value") / 50).cast("string")).when(k % 7 == 1, "Excellent shot").when(k % 7 == 2, "GOOD").when(k % 7 == 3, "about average").when(k % 7 == 4, "bad").when(k % 7 == 5, "NaN")
    return t.table(spark, d, "events").select(k.alias("id"), F.round(X.worthiness(value), 6).alias("worth"))


@r.query("""WITH x AS (SELECT event_id AS id, value / 10 AS span, least(1.0::DOUBLE, value / 100) AS worth, event_id % 3 AS n, (event_id % 50)::DOUBLE AS mid FROM events), y AS (SELECT *, CASE WHEN n > 1 THEN least(span + 3, 8) ELSE 2 + 4 * worth END AS len FROM x)
SELECT id, round(greatest(0, mid - 0.4 * len), 6) AS start, round(len, 6) AS duration, round(0.75 * worth + 0.25 * (mid / 50), 6) AS blended FROM y""")
def export_windows(spark, d):
    k = F.col("event_id")
    rows = t.table(spark, d, "events").select(k.alias("id"), (F.col("value") / 10).alias("span"), F.least(F.lit(1.0), F.col("value") / 100).alias("worth"), (k % 3).alias("n"), (k % 50).cast("double").alias("at"))
    w = X.export_window(F.col("span"), F.col("worth"), F.col("n"), F.col("at"))
    return rows.select("id", F.round(w.start, 6).alias("start"), F.round(w.duration, 6).alias("duration"), F.round(X.blend([(F.col("worth"), 3.0), (F.col("at") / 50, 1.0)]), 6).alias("blended"))


# Imports ------------------------------------------------------------------------------------------------------------


@r.query("""WITH f AS (SELECT p_partkey AS k, '/clips/' || p_brand || '/' || CASE p_partkey % 3 WHEN 0 THEN p_type || '@@@001_' || p_partkey || 'ms-' || (p_partkey + 2500) || 'ms.gif' WHEN 1 THEN p_type || '@@@002_' || p_size || '.5s-' || (p_size + 3) || 's.GIF' ELSE p_partkey || '.gif' END AS path FROM part)
SELECT 'cand_fs_' || sha256(path) AS id, path, CASE WHEN k % 3 < 2 THEN split_part(split_part(path, '/', 4), '@@@', 1) ELSE split_part(path, '/', 3) END AS source, CASE WHEN k % 3 = 0 THEN k::DOUBLE / 1000 ELSE 0 END AS start, CASE WHEN k % 3 = 0 THEN (k + 2500)::DOUBLE / 1000 ELSE 0 END AS "end" FROM f WHERE path NOT IN (SELECT path FROM f WHERE k % 8 = 0)""")
def folder_imports(spark, d):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    size = lambda n: (F.col("p_size") + n).cast("string")
    name = F.when(k % 3 == 0, F.concat("p_type", F.lit("@@@001_"), text, F.lit("ms-"), (k + 2500).cast("string"), F.lit("ms.gif"))).when(k % 3 == 1, F.concat("p_type", F.lit("@@@002_"), size(0), F.lit(".5s-"), size(3), F.lit("s.GIF"))).otherwise(F.concat(text, F.lit(".gif")))
    rows = t.table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("/clips/"), "p_brand", F.lit("/"), name).alias("path"))
    return files.folder_candidates(rows.select("path"), rows.where("k % 8 = 0").select("path"))


@r.query("""WITH l AS (SELECT 'v' || l_orderkey AS video, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n, l_quantity::DOUBLE AS start, l_quantity::DOUBLE + 2 AS "end" FROM lineitem)
SELECT 'adaptive-clip-' || lpad(n::VARCHAR, 4, '0') AS run_candidate_id, video, CASE WHEN substr(video, 2)::BIGINT % 2 = 0 THEN 'h' || video ELSE sha256(video) END AS sha256, start, "end" FROM l""")
def run_imports(spark, d):
    li = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("c"))
    video = F.concat(F.lit("v"), F.col("l_orderkey").cast("string"))
    results = li.select(video.alias("video"), F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("h"), video)).alias("sha256"), F.transform("c", lambda x: F.struct(x.q.alias("start"), (x.q + 2).alias("end"))).alias("top_clips"))
    return files.run_candidates(results)


@r.query("SELECT 'c' || (event_id % 700) AS candidate_id, arg_max(event_type, (ts::VARCHAR, event_type)) AS rating FROM events GROUP BY 1")
def judgment_imports(spark, d):
    """Written as lines of JSON, and read."""
    path = f"{shared_folder(spark)}/judgments-{uuid.uuid4().hex}"
    e = t.table(spark, d, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 700).cast("string")).alias("candidate_id"), F.col("event_type").alias("rating"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("judged_at"))
    e.write.json(path)
    return files.read_judgments(spark, path)


@r.query("""SELECT p_partkey || '' AS item_id, '/b/' || p_partkey || '.mp4' AS source_path, p_brand AS video_fingerprint, p_type AS pace_bucket, CASE p_partkey % 3 WHEN 0 THEN p_type || ',dark' WHEN 1 THEN 'fast' ELSE '' END AS tags FROM part""")
def benchmark_imports(spark, d):
    """Written as a table of comma-separated values with a header, and read."""
    path, k = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}", F.col("p_partkey")
    tags = F.when(k % 3 == 0, F.concat("p_type", F.lit(" | |dark"))).when(k % 3 == 1, " fast ").otherwise("")
    t.table(spark, d, "part").select(F.concat(F.lit(" /b/"), k.cast("string"), F.lit(".mp4")).alias("source_path"), F.concat("p_brand", F.lit(" ")).alias("video_fingerprint"), F.col("p_type").alias("pace_bucket"), tags.alias("difficulty_tags")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_benchmark(spark, path).select("item_id", "source_path", "video_fingerprint", "pace_bucket", F.array_join("difficulty_tags", ",").alias("tags"))


@r.query("SELECT doc_id AS id, CASE WHEN length(text) % 9 <> 0 THEN length(text)::DOUBLE END AS n, CASE WHEN length(text) % 9 = 0 THEN 'dimension' END AS reason FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL")
def embedding_backfill(spark, d):
    """In three parts, by a batch function that fails on some texts."""

    def embed(texts):
        return [[float(len(x)), 1.0] if len(x) % 9 else [0.0] for x in texts]

    docs = t.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    made = jobs.backfill(docs, docs.where("id % 5 = 0"), f"{shared_folder(spark)}/backfill-{uuid.uuid4().hex}", embed, 2, parts=3)
    return made.select("id", F.element_at("vector", 1).alias("n"), "reason")


# Sequential choices: SQL by recursion -------------------------------------------------------------------------------

r.ORACLE_SQL["temporally_distinct_clips"] = f"""WITH RECURSIVE {t.FRAMES}, o AS (SELECT frame AS id, video, ts::DOUBLE AS peak, row_number() OVER (PARTITION BY video ORDER BY score DESC, frame) AS n FROM fr),
g(n, video, id, taken, kept) AS (SELECT 1::BIGINT, video, id, true, [peak] FROM o WHERE n = 1 UNION ALL
 SELECT o.n, o.video, o.id, len(list_filter(g.kept, lambda x: abs(x - o.peak) <= 7200)) = 0, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - o.peak) <= 7200)) = 0 THEN list_append(g.kept, o.peak) ELSE g.kept END FROM g JOIN o ON o.video = g.video AND o.n = g.n + 1)
SELECT id, video FROM g WHERE taken"""

r.ORACLE_SQL["merged_clips"] = f"""WITH RECURSIVE {t.FRAMES}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 3600 AND score >= 0.1 AND lag(score) OVER w >= 0.1 THEN 0 ELSE 1 END AS x, row_number() OVER w AS n FROM fr WINDOW w AS (PARTITION BY video ORDER BY ts, frame)),
g(n, video, frame, ts, score, since, clip) AS (SELECT n, video, frame, ts, score, ts, 1::BIGINT FROM b WHERE n = 1 UNION ALL
 SELECT b.n, b.video, b.frame, b.ts, b.score, CASE WHEN x = 1 OR b.ts - g.since > 7200 THEN b.ts ELSE g.since END, CASE WHEN x = 1 OR b.ts - g.since > 7200 THEN g.clip + 1 ELSE g.clip END FROM g JOIN b ON b.video = g.video AND b.n = g.n + 1),
c AS (SELECT video, clip, min(ts)::DOUBLE AS a, max(ts)::DOUBLE AS z, count(*) AS k, max(score) AS score, arg_min(ts, (-score, ts, frame))::DOUBLE AS peak FROM g GROUP BY 1, 2)
SELECT video, CASE WHEN k > 1 AND score < 0.2 THEN peak ELSE a END AS start, CASE WHEN k > 1 AND score < 0.2 THEN peak ELSE z END AS "end", CASE WHEN k > 1 AND score < 0.2 THEN 1 ELSE k END AS frames, round(score, 6) AS score FROM c"""

_KEEPERS = f"""{t.VECTORS}, o AS (SELECT id, id % 50 AS grp, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u, row_number() OVER (PARTITION BY id % 50 ORDER BY (id * 31 % 97)::DOUBLE / 97 DESC, id) AS n FROM vec),
g(n, grp, id, hit, kept) AS (SELECT 1::BIGINT, grp, id, NULL::STRUCT(id BIGINT, s DOUBLE), [{{'id': id, 'u': u}}] FROM o WHERE n = 1 UNION ALL
 SELECT n, grp, id, hit, CASE WHEN hit IS NULL THEN list_append(kept, {{'id': id, 'u': u}}) ELSE kept END FROM (SELECT o.n, o.grp, o.id, o.u, g.kept, list_filter(list_transform(g.kept, lambda k: {{'id': k.id, 's': list_dot_product(k.u, o.u)}}), lambda k: k.s >= 0.3)[1] AS hit FROM g JOIN o ON o.grp = g.grp AND o.n = g.n + 1))"""
r.ORACLE_SQL["near_keepers"] = f"WITH RECURSIVE {_KEEPERS} SELECT id, coalesce(hit.id, id) AS keeper, round(hit.s, 6) AS similarity FROM g"
r.ORACLE_SQL["visually_distinct"] = f"WITH RECURSIVE {_KEEPERS} SELECT id FROM g WHERE hit IS NULL"


# Streams ------------------------------------------------------------------------------------------------------------


@r.query(f"WITH {t.EVENTS} SELECT target_id, event_id, rating FROM lat")
def streamed_ratings(spark, d):
    """The events as a stream of four files, and what it says of each target in the end."""
    name, store = "spark.sql.streaming.stateStore.providerClass", f"{shared_folder(spark)}/ratings-{uuid.uuid4().hex}"
    before = spark.conf.get(name)
    events = t.events(spark, d)
    events.repartition(4, "event_id").write.parquet(f"{store}/in")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{store}/in")
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{store}/out/n={n}")
        jobs.latest_ratings(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    last = spark.read.parquet(f"{store}/out").groupBy("target_id").agg(F.max_by(F.struct("event_id", "rating"), "batch").alias("x")).select("target_id", "x.*")
    return last.where("event_id is not null")
