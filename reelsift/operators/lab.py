"""Quality lab and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.operators.attention import stable_id
from reelsift.operators.scans import Segments


def run_status(items: DataFrame, key: str = "run") -> DataFrame:
    """A-09: status of a run from its items' statuses."""
    n = F.count("*")
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    status = F.when(c("completed") == n, "completed").when(c("cancelled") == n, "cancelled").when(c("failed") > 0, "partial_failure").when(c("running", "pending") > 0, "running").otherwise("unknown")
    return items.groupBy(key).agg(n.alias("items"), status.alias("run_status"))


def video_status(stages: DataFrame) -> DataFrame:
    """A-10: a video's status from those of its stages ``(video, stage, status)``."""
    c = lambda x: F.count_if(x)
    bad = F.col("status").isin("failed", "needs_attention")
    status = F.when(c((F.col("stage") == "gif_clip") & (bad | (F.col("status") == "cancelled"))) > 0, "needs_attention").when(c(bad) > 0, "needs_attention").when(c(F.col("status") == "cancelled") > 0, "cancelled").when(c(F.col("status").isin("pending", "running")) == 0, "succeeded").otherwise("running")
    return stages.groupBy("job", "video").agg(status.alias("video_status"))


def job_status(videos: DataFrame) -> DataFrame:
    """A-11, A-05: a job's status once all its videos are at an end, and their number."""
    over = F.col("video_status").isin("succeeded", "needs_attention", "cancelled", "failed")
    status = F.when(F.bool_and(over), F.when(F.bool_or(F.col("video_status").isin("failed", "needs_attention")), "needs_attention").otherwise("succeeded")).otherwise("running")
    return videos.groupBy("job").agg(F.count("*").alias("videos"), status.alias("job_status"))


def attention(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """J-21: jobs ``(job, status, created_at)`` that need attention themselves or have stages ``(job, status)`` that do, with the
    number of these, newest first."""
    waiting = stages.where("status = 'needs_attention'").groupBy("job").agg(F.count("*").alias("n"))
    rows = jobs.join(waiting, "job", "left").where((F.col("status") == "needs_attention") | F.col("n").isNotNull())
    return rows.select("job", "status", "created_at", F.coalesce("n", F.lit(0)).alias("attention_count")).orderBy(F.desc("created_at"), F.desc("job"))


def scorecard(values: DataFrame) -> DataFrame:
    """A-07: mean, least, greatest and count of each metric, by run and by config, in one pass of grouping sets."""
    rows = values.groupingSets([["config", "run", "metric"], ["config", "metric"]], "config", "run", "metric")
    r = lambda x: F.round(x, 4)
    return rows.agg(F.when(F.grouping("run") == 1, "config").otherwise("run").alias("grain"), r(F.avg("value")).alias("mean"), r(F.min("value")).alias("least"), r(F.max("value")).alias("greatest"), F.count("*").alias("n"))


def integrity(attempted: Column, succeeded: Column) -> Column:
    """A-08."""
    return F.when(attempted <= 0, 1.0).otherwise(succeeded / attempted)


def pairing(items: DataFrame, seed: int = 17) -> DataFrame:
    """W-11: items of a fingerprint paired in order of id, with an index by fingerprint and a side drawn by hash.

    The index runs within the first ids' blocks of fingerprints and over the blocks' totals, not over all pairs in one window.
    """
    w = Window.partitionBy("fingerprint").orderBy("item")
    rows = items.withColumn("rn", F.row_number().over(w) - 1).withColumn("b", F.lead("item").over(w)).where("rn % 2 = 0 and b is not null")
    pairs = rows.select("fingerprint", F.expr("rn div 2").alias("pair"), F.col("item").alias("a"), "b")
    totals = pairs.groupBy("fingerprint").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("fingerprint")) - F.col("c")).select("fingerprint", "before")
    return pairs.join(totals, "fingerprint").select("fingerprint", (F.col("before") + F.col("pair")).alias("pair_index"), "a", "b", (F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(2)) == 0).alias("left_is_a"))


def split(items: DataFrame, seed: int = 17, tune: float = 0.7) -> DataFrame:
    """W-12: tune or holdout, the same for all items of a fingerprint."""
    return items.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), "fingerprint"), F.lit(10_000)) < int(tune * 10_000), "tune").otherwise("holdout"))


def reveal(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """A-42, J-18: wins of each run, ties and rejects of sessions whose pairs are all judged."""
    rows = pairs.join(judgments, ["session", "pair_index"], "left")
    a = ((F.col("choice") == "left") & F.col("left_is_a")) | ((F.col("choice") == "right") & ~F.col("left_is_a"))
    b = ((F.col("choice") == "right") & F.col("left_is_a")) | ((F.col("choice") == "left") & ~F.col("left_is_a"))
    out = rows.groupBy("session").agg(F.count("*").alias("pairs"), F.count("choice").alias("judged"), F.count_if(a).alias("wins_a"), F.count_if(b).alias("wins_b"), F.count_if(F.col("choice") == "tie").alias("ties"), F.count_if(F.col("choice") == "both_bad").alias("both_bad"))
    return out.where("judged = pairs")


def next_pairs(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """J-17: the first pair of each session that no judgment names; sessions that are through have none."""
    rest = [c for c in pairs.columns if c not in ("session", "pair_index")]
    left = pairs.join(judgments.select("session", "pair_index"), ["session", "pair_index"], "left_anti")
    return left.groupBy("session").agg(F.min("pair_index").alias("pair_index"), *(F.min_by(c, "pair_index").alias(c) for c in rest))


def promotion(configs: DataFrame, runs: DataFrame, sessions: DataFrame, exports: DataFrame) -> DataFrame:
    """A-43: for each config, the reasons against promotion; none recorded counts as full integrity."""
    done = lambda s, name: runs.where(f"split = '{s}' and status = 'completed'").select("config").distinct().withColumn(name, F.lit(True))
    rows = configs.join(done("tune", "t"), "config", "left").join(done("holdout", "h"), "config", "left").join(sessions.select("config").distinct().withColumn("s", F.lit(True)), "config", "left").join(exports.groupBy("config").agg(F.avg("value").alias("i")), "config", "left")
    why = F.array_compact(F.array(F.when(F.col("t").isNull(), F.lit("no tune run")), F.when(F.col("h").isNull(), F.lit("no holdout run")), F.when(F.col("s").isNull(), F.lit("no session")), F.when(F.coalesce("i", F.lit(1.0)) < 0.9, F.lit("exports incomplete"))))
    return rows.select("config", F.array_join(why, "; ").alias("reasons"), (F.size(why) == 0).alias("promoted"))


def history(log: DataFrame, key: str = "config") -> DataFrame:
    """W-13, W-14: each promotion or publication with the one before it; the last is current."""
    w = Window.partitionBy("slot").orderBy("at", "id")
    return log.withColumn("previous", F.lag(key).over(w)).withColumn("current", F.lead(key).over(w).isNull())


def rollback_targets(log: DataFrame, key: str = "config") -> DataFrame:
    """W-14: for each slot of a log ``(slot, id, at, config, action)`` the current config and the one that a rollback gives back,
    which is that of the latest ``promote`` of another config; slots without one can't be rolled back and are left out."""
    now = log.groupBy("slot").agg(F.max_by(key, F.struct("at", "id")).alias("current"))
    earlier = log.where("action = 'promote'").join(now, "slot").where(F.col(key) != F.col("current"))
    return earlier.groupBy("slot", "current").agg(F.max_by(key, F.struct("at", "id")).alias("target"))


def publish(log: DataFrame, wanted: DataFrame, builds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W-13: rows to append to a log ``(slot, version, at)`` for publications or rollbacks ``wanted`` of the same columns, each with
    the version that it follows in its slot, and those refused: versions without a build, or whose build is not completed."""
    state = builds.groupBy("version").agg(F.max("status").alias("state"), F.bool_or(F.col("status") == "completed").alias("done"))
    rows = wanted.select("slot", "version", "at").join(state, "version", "left")
    fine = rows.where("done").select("slot", "version", "at", F.lit(True).alias("new"))
    w = Window.partitionBy("slot").orderBy("at", "new", "version")
    both = log.select("slot", "version", "at", F.lit(False).alias("new")).union(fine)
    appended = both.withColumn("previous", F.lag("version").over(w)).where("new").select("slot", "version", "at", "previous")
    return appended, rows.where("not coalesce(done, false)").select("slot", "version", "at", F.when(F.col("state").isNull(), "no build").otherwise("not completed").alias("reason"))


def next_versions(current: DataFrame, refreshed: DataFrame) -> DataFrame:
    """W-15: ranked items of refreshed collections as new versions; frozen collections are left out."""
    last = current.groupBy("collection").agg(F.max("version").alias("v"), F.bool_or("frozen").alias("frozen"))
    rows = refreshed.join(last, "collection", "left").where("frozen is null or not frozen")
    rows = Segments(rows, ["collection"], [F.desc("score"), "id"]).add(rank=("count", "id")).rows
    return rows.select("collection", (F.coalesce("v", F.lit(0)) + 1).cast("long").alias("version"), F.col("rank").cast("long").alias("rank"), "id")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """A-06: keys with several rows: count, first time, ids in order."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def inbox(*sources: DataFrame) -> DataFrame:
    """U-01, T-06: rows ``(kind, key, severity, title, created_at)`` of all sources with a stable id, worst and newest first."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.select(stable_id(F.col("kind"), F.col("key")).alias("id"), "kind", "severity", "title", "created_at", rank.alias("order")).orderBy("order", F.desc("created_at"), "id")


def audit(stages: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """A-52, J-24: succeeded clips without exactly one file and one manifest row of the same digest, and clips still open."""
    f = files.groupBy("clip").agg(F.count("*").alias("files"), F.min("sha256").alias("f"))
    m = manifest.groupBy("clip").agg(F.count("*").alias("rows"), F.min("sha256").alias("m"))
    rows = stages.join(f, "clip", "left").join(m, "clip", "left")
    fault = F.when(~F.col("status").isin("succeeded", "failed", "cancelled"), "open").when(F.col("status") != "succeeded", None).when(F.coalesce("files", F.lit(0)) != 1, "files").when(F.coalesce("rows", F.lit(0)) != 1, "manifest").when(F.col("f") != F.col("m"), "digest")
    return rows.withColumn("fault", fault).where("fault is not null").select("clip", "fault")


#: The statuses of a clip's stage that are final, and those of a job that is under way.
FINAL = ["succeeded", "failed", "cancelled", "needs_attention"]
ACTIVE = ["pending", "running", "leased", "retry_wait"]


def clip_outcomes(stages: DataFrame) -> DataFrame:
    """A-51: clips of each video in each final status; stages that are no clip's or not through don't count."""
    ended = stages.where((F.col("stage") == "gif_clip") & F.col("status").isin(FINAL))
    return ended.groupBy("video").agg(*(F.count_if(F.col("status") == s).alias(s) for s in FINAL))


def job_counts(jobs: DataFrame) -> DataFrame:
    """A-51: one row: jobs ``(status)`` in all, under way, and in each status that is told."""
    told = ["pending", "succeeded", "needs_attention", "cancelled"]
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(ACTIVE)).alias("active"), *(F.count_if(F.col("status") == s).alias(s) for s in told))


def severity_counts(items: DataFrame) -> DataFrame:
    """A-51: one row: items of the inbox of each severity; one without is information."""
    kind = F.coalesce("severity", F.lit("info"))
    return items.agg(*(F.count_if(kind == s).alias(s) for s in ("error", "warning", "info")))


def canonical(entries: DataFrame, name: str) -> DataFrame:
    """Of each config's ``(config, key, value)``, texts all, the JSON by sorted keys. Of a key that occurs twice the greatest value
    counts; null values stay as null."""
    one = entries.groupBy("config", "key").agg(F.max("value").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return one.groupBy("config").agg(F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"}).alias(name))


def config_snapshots(settings: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """S-17: of each config's settings the canonical JSON and that one's sha256 as id; with ``provenance`` of the same columns its JSON
    too, which says nothing of the id. A config without provenance has an empty object."""
    rows = canonical(settings, "settings").select("config", F.sha2("settings", 256).alias("config_id"), "settings")
    if provenance is None:
        return rows
    return rows.join(canonical(provenance, "provenance"), "config", "left").withColumn("provenance", F.coalesce("provenance", F.lit("{}")))
