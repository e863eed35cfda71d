"""Where candidates come from, what is annotated, and what a synthesis reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def provenance(candidates: DataFrame, jobs: DataFrame, stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """J-15: the trail of every candidate ``(id, job, video)``: a row for each stage of its video, with the job's status, the
    stage's and the number of its artifacts. A candidate whose video has no stages keeps one row."""
    steps = stages.groupBy("video", "stage").agg(F.max("status").alias("stage_status"))
    made = artifacts.groupBy("video", "stage").agg(F.count("*").alias("n"))
    steps = steps.join(made, ["video", "stage"], "left")
    rows = candidates.join(jobs.select("job", F.col("status").alias("job_status")), "job", "left").join(steps, "video", "left")
    return rows.select("id", "job", "job_status", "video", "stage", "stage_status", F.coalesce("n", F.lit(0)).alias("artifacts"))


def synthesis_frames(frames: DataFrame, most: int = 8) -> DataFrame:
    """A-48: the first ``most`` frames of each video in order of time, as an array of structs."""
    rank = F.row_number().over(Window.partitionBy("video").orderBy("ts", "frame"))
    rows = frames.withColumn("rn", rank).where(F.col("rn") <= most)
    return rows.groupBy("video").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "frame", "score"))).alias("frames"))


def representative_coverage(media: DataFrame, annotations: DataFrame) -> DataFrame:
    """A-50: representatives, those annotated and those that remain, and the annotated share of gifs (null without gifs)."""
    rows = media.join(annotations.select("id").distinct().withColumn("has", F.lit(True)), "id", "left")
    lead, gif, has = F.coalesce("is_representative", F.lit(False)), F.coalesce(F.col("media_type") == "gif", F.lit(False)), F.col("has").isNotNull()
    out = rows.agg(F.count_if(lead).alias("total"), F.count_if(lead & has).alias("annotated"), F.count_if(gif).alias("gifs"), F.count_if(gif & has).alias("known"))
    return out.select("total", "annotated", (F.col("total") - F.col("annotated")).alias("remaining"), F.round(F.when(F.col("gifs") > 0, F.col("known") / F.col("gifs")), 4).alias("gif_share"))
