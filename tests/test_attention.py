"""The attention inbox: limits, ties, missing fields, digests of many copies."""

import datetime as dt

from pyspark.sql import functions as F

from reelsift.operators import attention
from reelsift.sources import files

DAY = dt.datetime(2024, 1, 1)


def test_sources_and_limits(spark):
    jobs = spark.createDataFrame([(1, None, "needs_attention", DAY), (2, "/b", "needs_attention", None), (3, "/c", "running", DAY)], "job_id long, directory string, status string, created_at timestamp")
    videos = spark.createDataFrame([(10, 1), (11, 9)], "video_id long, job_id long")
    stages = spark.createDataFrame([(5, 10, "score", "needs_attention", None, DAY), (6, 11, "score", "needs_attention", "x", DAY), (7, 10, None, "needs_attention", '{"error": "e"}', DAY + dt.timedelta(1))], "stage_id long, video_id long, stage_name string, status string, last_error string, created_at timestamp")
    sources = [attention.stage_failures(stages, videos, jobs, 5), attention.job_failures(jobs, 5)]
    got = attention.attention(sources).collect()
    assert [(x.severity, x.title, x.detail) for x in got] == [
        ("error", "Task job needs attention: ", "Job 1 is in 'needs_attention' status."), ("error", "Task job needs attention: /b", "Job 2 is in 'needs_attention' status."),
        ("warning", "Stage '' needs attention", "e"), ("warning", "Stage 'score' needs attention", "No error details recorded.")]
    # Fixed value: the first 16 hex digits of the sha256 of task_failure:job:1.
    assert got[0].attention_id == "att_" + spark.range(1).select(F.sha2(F.lit("task_failure:job:1"), 256)).first()[0][:16]
    assert [x.title for x in attention.attention(sources, 1).collect()] == ["Task job needs attention: "]
    assert attention.attention([s.limit(0) for s in sources]).isEmpty()


def test_a_digest_of_many_copies(spark):
    media = spark.range(350).select(F.col("id").alias("media_id"), F.when(F.col("id") >= 300, F.lit(None)).when(F.col("id") % 3 == 0, "a" * 64).when(F.col("id") < 10, "b" * 64).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("sha256"), F.timestamp_seconds("id").alias("created_at"))
    got = attention.duplicate_media(media).orderBy("title").collect()
    assert [x.title for x in got] == ["Duplicate media (100 copies)", "Duplicate media (6 copies)"]
    assert got[1].detail == "SHA256 bbbbbbbbbbbbbbbb... appears in 6 media records. Media IDs: 1,2,4,5,7,8"
    assert attention.copies(media).count() == 106
    more = attention.duplicate_media(media.union(media.limit(4).withColumn("media_id", F.col("media_id") + 1000)), 1).first()
    assert more.title == "Duplicate media (102 copies)" and more.detail.endswith(",297,...")


def test_export_with_names(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, 0, 7), (1, 2, 0, 8), (2, 1, 0, 7)], "collection long, version long, rank long, id long")
    known = spark.createDataFrame([(1, "one", None), (3, "three", "{}")], "collection long, name string, search string")
    path = f"file://{tmp_path}/out"
    files.export_collections(items, spark.createDataFrame([(7,)], "id long"), path, known)
    assert [(x.collection, x.version, x.name, x.search, x.exported, x.missing) for x in spark.read.json(f"{path}/manifest").collect()] == [(1, 2, "one", "{}", 0, 1)]
    assert [tuple(x) for x in files.named_manifests(files.collection_manifest(items, items.select("id").distinct())[2], known)[1].collect()] == [(3, "three")]
