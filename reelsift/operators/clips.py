"""Scored frames to ranked clips; intervals on a timeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.operators.greedy import independent
from reelsift.operators.scans import Segments


def sampling_grid(videos: DataFrame, step: int, longest: int) -> DataFrame:
    """U-05: sample times of ``(video, duration)``: 0, step, ... below the duration less the longest clip."""
    last = F.floor("duration").cast("long") - longest
    return videos.select("video", F.explode(F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1, F.lit(step).cast("long")))).alias("ts"))


def refinement(frames: DataFrame, videos: DataFrame, threshold: float, radius: int, step: int) -> DataFrame:
    """U-02: times around high-scored frames, within the video, less those sampled already."""
    near = frames.where(F.col("score") >= threshold).select("video", F.explode(F.sequence(F.col("ts") - radius, F.col("ts") + radius, F.lit(step).cast("long"))).alias("ts")).distinct()
    near = near.join(videos, "video").where((F.col("ts") >= 0) & (F.col("ts") <= F.col("duration") - 1)).select("video", "ts")
    return near.join(frames.select("video", "ts").distinct(), ["video", "ts"], "left_anti")


def united(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """U-07: one frame per video and time, the better scored."""
    rows = coarse.unionByName(fine)
    rest = [c for c in rows.columns if c not in ("video", "ts")]
    return rows.groupBy("video", "ts").agg(F.max_by(F.struct(*rest), F.struct(*(["score"] + [c for c in rest if c != "score"]))).alias("x")).select("video", "ts", "x.*")


def islands(frames: DataFrame, gap: float, threshold: float) -> DataFrame:
    """W-05: frames with the number of their island: a new one after a longer gap, or where either neighbour is below the threshold."""
    broken = (F.col("ts") - F.col("__t") > gap) | (F.col("score") < threshold) | (F.col("__s") < threshold)
    runs = Segments(frames, ["video"], ["ts", "frame"]).add(__t=("lag", "ts"), __s=("lag", "score")).map(__new=F.coalesce(broken, F.lit(True)).cast("long"))
    return runs.add(island=("sum", "__new")).rows.drop("__t", "__s", "__new")


def clips(frames: DataFrame, gap: float = 15.0, threshold: float = 0.3, longest: float = 24.0, peak: float = 0.0) -> DataFrame:
    """W-06: frames merged into clips of at most ``longest`` seconds (0: any); a weak clip becomes its best frame.

    The cap runs along a video's frames in order; a task carries only the clip that is open, so an island may be of any length.
    Frames without a time are left out.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, since, number = None, 0.0, 0
        for rows in batches:
            if rows.empty:
                continue
            ts, clip = rows["ts"].to_numpy(), np.empty(len(rows), np.int64)
            place = list(zip(rows["part"], rows["island"]))
            heads = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]]
            for i, j in zip(heads, [*heads[1:], len(place)]):
                if place[i] != last:
                    last, since, number = place[i], ts[i], number + 1
                while i < j:
                    end = i + int(np.searchsorted(ts[i:j], since + longest, "right")) if longest > 0 else j
                    # Sums and differences round differently; the difference decides.
                    while longest > 0 and end < j and ts[end] - since <= longest:
                        end += 1
                    while longest > 0 and end > i and ts[end - 1] - since > longest:
                        end -= 1
                    clip[i:end] = number
                    if end < j:
                        since, number = ts[end], number + 1
                    i = end
            yield rows.drop(columns="part").assign(g=clip)

    # Video numbers may be of any type; equal ones are told apart by a hash, which sorts with them.
    rows = islands(frames.where("ts is not null"), gap, threshold).select(F.xxhash64("video").alias("part"), "video", "island", F.col("ts").cast("double"), F.col("frame").cast("long"), F.col("score").cast("double"))
    rows = rows.repartition("part").sortWithinPartitions("part", "video", "island", "ts", "frame")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "part")
    cut_ = rows.mapInPandas(cut, f"{schema}, g long")
    best = F.max_by(F.struct("ts", "frame", "score"), F.struct("score", -F.col("ts"), -F.col("frame")))
    out = cut_.groupBy("video", "island", "g").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), best.alias("best"))
    weak = (F.col("n") > 1) & (F.col("best.score") < peak)
    return out.select("video", F.when(weak, F.col("best.ts")).otherwise(F.col("a")).alias("start"), F.when(weak, F.col("best.ts")).otherwise(F.col("b")).alias("end"), F.when(weak, 1).otherwise(F.col("n")).alias("frames"), F.col("best.ts").alias("peak"), F.col("best.score").alias("score"))


def temporal_dedup(clips_: DataFrame, min_gap: float) -> DataFrame:
    """T-09: clips ``(id, video, peak, score)`` in order of score, each kept unless a kept one of its video peaks within the gap."""
    bins = clips_.select("id", "video", "peak", "score", F.floor(F.col("peak") / min_gap).alias("bin"))
    other = bins.select(F.col("id").alias("other"), "video", F.col("peak").alias("at"), F.col("score").alias("rival"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    edges = bins.join(other, ["video", "bin"]).where((F.abs(F.col("peak") - F.col("at")) <= min_gap) & (F.struct(-F.col("rival"), F.col("other")) < F.struct(-F.col("score"), F.col("id")))).select("id", "other")
    return clips_.join(independent(clips_.select("id"), edges), "id", "left_semi")


def export_quota(rows: DataFrame, ratio: float, most: int) -> DataFrame:
    """T-03, T-04: clips ranked within their video by score and id, down to the quota: the share, at most ``most`` if that is over 0, at least 1."""
    size = rows.groupBy(F.col("video").alias("__video")).agg(F.count("*").alias("__size"))
    quota = F.floor(F.col("__size") * ratio)
    quota = F.greatest(F.lit(1), F.least(quota, F.lit(most)) if most > 0 else quota)
    ranked = Segments(rows, ["video"], [F.desc("score"), "id"]).add(rank=("count", "id")).rows
    return ranked.join(size, F.col("video").eqNullSafe(F.col("__video"))).withColumn("quota", quota).where("rank <= quota").drop("__video", "__size")


def histogram(rows: DataFrame) -> DataFrame:
    """A-25: scores in the bins [0, .3) [.3, .5) [.5, .7) [.7, .9) [.9, 1], with the empty ones."""
    edges = [0.3, 0.5, 0.7, 0.9]
    bin_ = sum((F.when(F.col("score") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counts = rows.where("score between 0 and 1").groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(5).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def coverage(intervals: DataFrame, videos: DataFrame) -> DataFrame:
    """A-41, W-09: share of each video's duration that its intervals cover, at most 1; 0 for no duration."""
    fresh = F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", F.coalesce("__upto", F.col("start"))))
    runs = Segments(intervals.where("end > start").select("video", "start", "end"), ["video"], ["start", "end"]).add(__upto=("max_before", "end")).rows
    covered = runs.select("video", fresh.alias("fresh")).groupBy("video").agg(F.sum("fresh").alias("covered"))
    share = F.when(F.col("duration") > 0, F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0)) / F.col("duration"))).otherwise(0.0)
    return videos.join(covered, "video", "left").select("video", F.round(share, 6).alias("coverage"))


def overlaps(windows: DataFrame, intervals: DataFrame, width: float = 600.0) -> DataFrame:
    """J-05: intervals ``(id, video, start, end)`` that overlap each window ``(window_id, video, from, to)``.

    Both sides go to the time bins that they touch, and meet in the first bin that they share.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    left = windows.withColumn("bin", bins(F.col("from"), F.col("to")))
    right = intervals.withColumn("bin", bins(F.col("start"), F.col("end")))
    hit = left.join(right, ["video", "bin"]).where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")) & (F.col("bin") == F.floor(F.greatest("start", "from") / width)))
    return hit.select("window_id", "id")


def thumbnails(spans: DataFrame, budget: int) -> DataFrame:
    """W-10: the first ``budget`` spans of a video that have a thumbnail keep it: scenes first, then the others by start."""
    order = [F.when(F.col("kind") == "scene", 0).otherwise(1), F.col("start"), F.col("id")]
    rows = Segments(spans, ["video"], order).add(__n=("sum", F.col("thumb").isNotNull().cast("long"))).rows
    return rows.withColumn("shown", F.col("thumb").isNotNull() & (F.col("__n") <= budget)).drop("__n")
