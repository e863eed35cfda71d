"""The driver's tables in the shapes that the operators take, and the same shapes in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.operators.feedback import chosen

RATING_OF = {"purchase": "favorite", "click": "like", "error": "dislike", "view": "neutral", "signup": "skip"}
STATUSES = ["candidate", "promoted", "liked", "archived"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback events; some are undone, and some correct the event of the same target before them."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", (F.col("event_id") % 500).alias("target_id"), (F.col("user_id") % 20).cast("long").alias("source"), chosen(F.col("event_type"), RATING_OF).alias("rating"), ts.alias("created_at"), F.when(F.col("event_id") % 41 == 0, ts).alias("undone_at"), F.when((F.col("event_id") % 37 == 0) & (F.col("event_id") >= 500), F.col("event_id") - 500).alias("supersedes_event_id"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RATING_OF.items())
EVENTS = f"""ev AS (SELECT event_id, event_id % 500 AS target_id, (user_id % 20)::BIGINT AS source, CASE event_type {_CASES} END AS rating, ts AS created_at,
  CASE WHEN event_id % 41 = 0 THEN ts END AS undone_at, CASE WHEN event_id % 37 = 0 AND event_id >= 500 THEN event_id - 500 END AS supersedes_event_id FROM events),
eff AS (SELECT * FROM ev WHERE undone_at IS NULL AND event_id NOT IN (SELECT supersedes_event_id FROM ev WHERE supersedes_event_id IS NOT NULL)),
lat AS (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, event_id DESC) = 1),
pro AS (SELECT * FROM eff WHERE rating IN ('like', 'dislike', 'favorite') QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY created_at DESC, event_id DESC) = 1),
mark AS (SELECT max(created_at) AS m FROM pro),
wei AS (SELECT pro.*, CASE WHEN rating = 'favorite' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * power(0.5::DOUBLE, (epoch_us(m) - epoch_us(created_at)) / 86400e6 / 30) AS weight FROM pro, mark)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


VECTORS = "vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, label::BIGINT AS label FROM embeddings)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, n = vectors(spark, sf_dir), F.col("id")
    return v.select("id", F.when(n % 17 != 0, F.col("vector")).alias("vector"), F.when(n % 13 != 0, F.array(F.concat(F.lit("label:"), F.col("label").cast("string")))).otherwise(F.array().cast("array<string>")).alias("keys"), (0.3 + (n % 70) / 100).alias("base"), (n % 20).alias("source"))


CANDIDATES = VECTORS + """,
cand AS (SELECT id, CASE WHEN id % 17 <> 0 THEN vector END AS vector, CASE WHEN id % 13 <> 0 THEN 'label:' || label END AS key, 0.3::DOUBLE + (id % 70)::DOUBLE / 100 AS base, id % 20 AS source FROM vec)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored frames: seconds of events as times, value as score."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("video"), F.floor(seconds(F.col("ts")) / 1_000_000).alias("ts"), F.col("event_id").alias("frame"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))


FRAMES = "fr AS (SELECT user_id::BIGINT AS video, (epoch_us(ts) // 1000000)::BIGINT AS ts, event_id AS frame, least(1.0::DOUBLE, value / 100) AS score FROM events)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = (F.floor(seconds(F.col("ts")) / 1_000_000) % 86_400).cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("long").alias("video"), start.alias("start"), (start + F.col("value") / 10).alias("end"))


INTERVALS = "iv AS (SELECT event_id AS id, user_id::BIGINT AS video, ((epoch_us(ts) // 1000000) % 86400)::DOUBLE AS s, ((epoch_us(ts) // 1000000) % 86400)::DOUBLE + value / 10 AS e FROM events)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return q.join(d.select("doc_id", "n_chars", "source"), "doc_id").select(F.col("doc_id").alias("id"), F.least(F.lit(1.0), F.col("n_chars") / 8000).alias("score"), F.col("quality").alias("label"), F.col("source"))


LABELLED = "lb AS (SELECT l.doc_id AS id, least(1.0::DOUBLE, n_chars / 8000) AS score, quality AS label, source FROM labels l JOIN documents d USING (doc_id))"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit hashes; every third one is a neighbour's with a few bits turned."""
    h = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16), 16, -10).cast("long")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), h.alias("bits"))
    near = d.where("id % 3 = 0").select((F.col("id") + 100_000_000).alias("id"), F.col("bits").bitwiseXOR(F.expr("shiftleft(5L, cast(id % 60 as int))")).alias("bits"))
    return d.union(near)


HASHES = """h0 AS (SELECT doc_id AS id, ('0x' || substr(sha256(coalesce(text, '')), 1, 16))::UBIGINT AS bits FROM documents),
hs AS (SELECT * FROM h0 UNION ALL SELECT id + 100000000, xor(bits, 5::UBIGINT << (id % 60)::UBIGINT) FROM h0 WHERE id % 3 = 0)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, their lines as stages of videos."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 2 == 0), "running").when(F.col("l_linenumber") == 7, "cancelled").otherwise("succeeded")
    return li.select(F.col("l_orderkey").alias("job"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).cast("long").alias("video"), F.when(F.col("l_linenumber") > 4, "gif_clip").otherwise("score").alias("stage"), status.alias("status"))


STAGES = """st AS (SELECT l_orderkey AS job, (l_orderkey * 10 + l_linenumber % 2)::BIGINT AS video, CASE WHEN l_linenumber > 4 THEN 'gif_clip' ELSE 'score' END AS stage,
  CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'running' WHEN l_linenumber = 7 THEN 'cancelled' ELSE 'succeeded' END AS status FROM lineitem),
vs AS (SELECT job, video, CASE WHEN bool_or(stage = 'gif_clip' AND status IN ('failed', 'needs_attention', 'cancelled')) THEN 'needs_attention' WHEN bool_or(status IN ('failed', 'needs_attention')) THEN 'needs_attention'
  WHEN bool_or(status = 'cancelled') THEN 'cancelled' WHEN NOT bool_or(status IN ('pending', 'running')) THEN 'succeeded' ELSE 'running' END AS video_status FROM st GROUP BY 1, 2)"""
