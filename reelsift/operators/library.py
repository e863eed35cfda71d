"""The media library: joins and counts over its tables, listings, picks, texts to embed, and moves of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import hamming, hash_bits, strip
from reelsift.operators.catalog import hamming_pairs
from reelsift.operators.greedy import shared_checkpoints

#: The keys of a summary that an embedding text takes, in order.
SUMMARY_KEYS = ["caption", "summary", "emotion", "emotional_core", "scene_type", "reason"]


# Joins and counts


def with_details(neighbours: DataFrame, annotations: DataFrame) -> DataFrame:
    """J-01: neighbours ``(id, ...)`` with what is known of each; unknown ones stay."""
    return neighbours.join(annotations, "id", "left")


def having(media: DataFrame, *others: DataFrame) -> DataFrame:
    """J-02, J-20: rows whose id every other table has, once each."""
    return reduce(lambda rows, other: rows.join(other.select("id"), "id", "left_semi"), others, media)


def lacking(media: DataFrame, *others: DataFrame) -> DataFrame:
    """J-03, J-23: rows whose id no other table has. A null id is lacking everywhere."""
    return reduce(lambda rows, other: rows.join(other.select("id"), "id", "left_anti"), others, media)


def current_members(collections: DataFrame, members: DataFrame) -> DataFrame:
    """J-16: collections ``(collection, current_version, ...)`` with the members of that version; empty ones stay."""
    return collections.join(members.withColumnRenamed("version", "current_version"), ["collection", "current_version"], "left")


def with_vector(rows: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """J-19: rows with their vector, or one of zeros."""
    return rows.join(vectors.select("id", "vector"), "id", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)))


def library_counts(**tables: DataFrame) -> DataFrame:
    """A-01: the number of rows of each table, as one row."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)


def index_consistency(index: DataFrame, id_map: DataFrame, refs: DataFrame) -> DataFrame:
    """A-14: sizes of the index, its id map and the stored references, ids of the map without reference, and whether all agree."""
    sizes = library_counts(indexed=index, mapped=id_map, referenced=refs, unreferenced=lacking(id_map, refs))
    return sizes.withColumn("consistent", (F.col("indexed") == F.col("mapped")) & (F.col("mapped") == F.col("referenced")) & (F.col("unreferenced") == 0))


def job_summary(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """A-05: videos, stages and stages of clips of each job; jobs without stages have none."""
    counts = stages.groupBy("job").agg(F.count_distinct("video").alias("videos"), F.count("*").alias("stages"), F.count("clip").alias("clips"))
    return jobs.select("job").join(counts, "job", "left").na.fill(0, ["videos", "stages", "clips"])


def outcome_report(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """A-49: rows of each outcome, those that did not occur with 0."""
    all_of = rows.sparkSession.createDataFrame([(o,) for o in outcomes], "outcome string")
    return all_of.join(rows.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").na.fill(0, ["n"])


# Listings


def shown_status(candidates: DataFrame, favorites: DataFrame) -> DataFrame:
    """P-07: candidates with ``shown``, which is ``favorited`` for a favorite, and the path to show."""
    marks = favorites.select("id").distinct().withColumn("favorite", F.lit(True))
    rows = candidates.join(marks, "id", "left")
    return rows.withColumn("shown", F.when(F.col("favorite"), "favorited").otherwise(F.col("status"))).withColumn("path", F.coalesce("preview_path", "artifact_path")).drop("favorite")


def status_counts(candidates: DataFrame, favorites: DataFrame) -> DataFrame:
    """A-03: candidates of each status as shown."""
    return shown_status(candidates, favorites).groupBy(F.col("shown").alias("status")).agg(F.count("*").alias("n"))


def status_view(candidates: DataFrame, favorites: DataFrame, status: str = "all") -> DataFrame:
    """P-07: candidates of a view, with the status they are shown with. ``candidate`` has those of that status that are no
    favorites, ``favorited`` all favorites, any other the candidates of that stored status, favorites among them."""
    rows = shown_status(candidates, favorites)
    if status == "all":
        return rows
    if status == "favorited":
        return rows.where("shown = 'favorited'")
    rows = rows.where(F.col("status") == status)
    return rows.where("shown <> 'favorited'") if status == "candidate" else rows


def candidate_list(candidates: DataFrame, favorites: DataFrame, status: str = "all", folder: str | None = None, after: tuple | None = None, size: int | None = None) -> DataFrame:
    """P-07: a status view, newest first: all of it, or a page of ``size`` rows after the ``(created_at, id)`` of the last row seen.
    ``folder`` is what the artifact's path begins with, separated by a slash of either kind."""
    rows = status_view(candidates, favorites, status)
    if folder:
        base = folder.rstrip("/\\")
        inside = lambda p: F.startswith(F.translate("artifact_path", "\\", "/"), F.lit(p.replace("\\", "/") + "/"))
        rows = rows.where(inside(base))
    if after:
        rows = rows.where(F.struct("created_at", "id") < F.struct(F.lit(after[0]).cast(rows.schema["created_at"].dataType), F.lit(after[1]).cast(rows.schema["id"].dataType)))
    rows = rows.orderBy(F.desc("created_at"), F.desc("id"))
    return rows.limit(size) if size else rows


def folder_rollup(candidates: DataFrame, favorites: DataFrame, files: DataFrame, root: str, statuses: list[str], status: str = "all", suffix: str = ".gif") -> DataFrame:
    """A-04: folders at or under ``root`` that hold the artifact of a row of the status view, or a file of the suffix without a row.

    ``files(path)`` is what is there. Of each folder: n, rows whose file is not there (``missing``), files that no row of any
    status names (``unmaterialized``, in the views of all and of candidates, where each counts as a candidate), and what there
    is of each status as shown. Rows without a path, or with one elsewhere, are skipped. By depth, then name.
    """
    root = root.rstrip("/")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = candidates.where("artifact_path is not null").select(F.col("artifact_path").alias("path"))
    there = files.select("path").distinct()
    rows = status_view(candidates, favorites, status).select(F.col("artifact_path").alias("path"), "shown").where("path is not null")
    found = rows.join(there.withColumn("there", F.lit(True)), "path", "left").select(parent.alias("folder"), F.col("shown"), F.col("there").isNull().alias("missing"), F.lit(False).alias("unmaterialized"))
    if status in ("all", "candidate"):
        alone = there.where(F.endswith(F.lower("path"), F.lit(suffix))).join(named, "path", "left_anti")
        found = found.union(alone.select(parent, F.lit("candidate"), F.lit(False), F.lit(True)))
    found = found.where((F.col("folder") == root) | F.startswith("folder", F.lit(root + "/")))
    counts = [F.count_if(F.col("shown") == s).alias(s) for s in statuses]
    out = found.groupBy("folder").agg(F.count("*").alias("n"), F.count_if("missing").alias("missing"), F.count_if("unmaterialized").alias("unmaterialized"), *counts)
    relative = F.when(F.col("folder") == root, ".").otherwise(F.substr("folder", F.lit(len(root) + 2)))
    out = out.withColumn("relative", relative).withColumn("depth", (F.length("relative") - F.length(F.replace("relative", F.lit("/"), F.lit("")))).cast("long"))
    return out.orderBy("depth", F.lower("relative"))


def profile_list(builds: DataFrame, publications: DataFrame) -> DataFrame:
    """P-21, T-20: builds newest first, with whether each is the published one and may be published."""
    now = publications.orderBy(F.desc("published_at"), F.desc("version")).limit(1).select("version", F.lit(True).alias("current"))
    rows = builds.join(F.broadcast(now), "version", "left").withColumn("current", F.coalesce("current", F.lit(False))).withColumn("publishable", F.col("status") == "completed")
    return rows.orderBy(F.desc("created_at"), F.desc("version"))


def latest_checkpoints(rows: DataFrame) -> DataFrame:
    """W-08: the last ``(id, phase, state)`` of each phase."""
    return rows.groupBy("phase").agg(F.max("id").alias("id"), F.max_by("state", "id").alias("state"))


def high_value(rows: DataFrame, least: float = 0.7, limit: int = 20) -> DataFrame:
    """T-05: open candidates worth a review, best first."""
    return rows.where((F.col("status") == "candidate") & (F.col("final_score") >= least)).orderBy(F.desc("final_score"), "id").limit(limit)


def picks(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """T-18, T-21: n rows in an order that depends on the seed and the id alone."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256)).limit(n)


# Frames


def bright(frames: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """P-08: frames brighter than the threshold (all, if it isn't positive), and counts of kept and dropped ones by video."""
    keep = F.lit(threshold <= 0) | F.coalesce(F.col("brightness") > threshold, F.lit(False))
    return frames.where(keep), frames.groupBy("video").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def worthy(frames: DataFrame, least: float) -> DataFrame:
    """P-09: frames of a score of at least ``least``."""
    return frames.where(F.col("score") >= least)


def scorable(media: DataFrame, kinds: tuple[str, ...] = ("gif", "image")) -> DataFrame:
    """P-10: media of the kinds that are scored."""
    return media.where(F.col("media_type").isin(*kinds))


def exported(failed: Column, exists: Column, size: Column, new: Column) -> Column:
    """P-12: whether an export has succeeded; what is unknown has not."""
    return F.coalesce(~failed & exists & (size > 0) & new, F.lit(False))


def best_frame(frames: DataFrame, keys: list[str]) -> DataFrame:
    """T-19: of each group the frame ``(idx, caption, notes)`` with the longest notes among those with a caption, the first on ties."""
    size = F.aggregate(F.coalesce("notes", F.array().cast("array<string>")), F.lit(0), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    rows = frames.where(F.coalesce("caption", F.lit("")) != "").withColumn("size", size).where("size > 0")
    return rows.groupBy(*keys).agg(F.max_by("idx", F.struct("size", -F.col("idx"))).alias("idx"), F.max("size").alias("size"))


def emotion_shares(frames: DataFrame) -> DataFrame:
    """A-46: frames of each emotion."""
    return frames.groupBy("emotion").agg(F.count("*").alias("n"))


def neighbour_vocabulary(neighbours: DataFrame, keys: list[str], most: int = 20) -> DataFrame:
    """A-46: the distinct emotions of each group's neighbours, and the first ``most`` of their tags in lower case.

    Tags are made distinct before they are gathered, so that a group's row is bounded by its vocabulary.
    """
    tags = neighbours.select(*keys, F.explode("tags").alias("tag")).select(*keys, F.lower("tag").alias("tag")).distinct()
    ranked = tags.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("tag"))).where(F.col("n") <= most)
    emotions = neighbours.groupBy(*keys).agg(F.array_sort(F.collect_set("emotion")).alias("emotions"))
    return emotions.join(ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("tag")).alias("tags")), keys, "left")


def diverse_frames(frames: DataFrame, distance: int = 10, most: int = 9) -> DataFrame:
    """T-11: per video the first ``most`` frames ``(video, frame, score, bits)`` by score that differ in more than ``distance`` bits
    from all chosen before. Frames with a bad hash are far from all.

    A frame can only be shut out by one that is chosen, so each round takes the best open frame of every video, and closes
    what is near it: ``most`` rounds of an aggregation and a join on the video, whatever the number of frames.
    """
    open_, chosen = frames.select("video", "frame", "score", "bits"), None
    for rank in range(1, most + 1):
        best = open_.groupBy("video").agg(F.max_by(F.struct("frame", "bits"), F.struct("score", -F.col("frame"))).alias("best"))
        picked = best.select("video", F.col("best.frame").alias("frame"), F.lit(rank).alias("rank"))
        chosen = picked if chosen is None else chosen.union(picked)
        near = hamming(F.col("bits"), F.col("best.bits")) <= distance
        open_ = open_.join(best, "video").where(~near & (F.col("frame") != F.col("best.frame"))).select("video", "frame", "score", "bits")
        if rank % 3 == 0:
            open_ = open_.checkpoint()
    return chosen


# Texts and ids


def candidate_text(artifact: Column, preview: Column, video: Column, start: Column, end: Column, summary: Column, tags: Column, keys: Column, fallback: Column) -> Column:
    """X-09: the text that stands for a candidate: file names, times, summary in the order of SUMMARY_KEYS, tags, scenario keys."""
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    times = F.concat(F.lit("clip "), F.format_string("%.1f", start), F.lit("s to "), F.format_string("%.1f", end), F.lit("s"))
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    parts = F.concat(F.array(name(F.coalesce(F.nullif(artifact, F.lit("")), preview)), name(video), times, *(summary[k] for k in SUMMARY_KEYS)), listed(tags), listed(keys))
    text = F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), " ")
    return F.when(text != "", text).otherwise(fallback.cast("string"))


def annotation_text(summary: Column, emotion: Column, why: Column, tags: Column) -> Column:
    """X-10: the text that stands for an annotation."""
    parts = F.concat(F.array(summary, emotion, why), F.coalesce(tags, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def clip_id(video: Column, start: Column, end: Column, position: Column) -> Column:
    """X-21: the first 16 hex digits of the sha256 of video, start, end and position."""
    return F.substring(F.sha2(F.concat_ws(":", video, start.cast("string"), end.cast("string"), position.cast("string")), 256), 1, 16)


# Scores and moves


def review_scores(candidates: DataFrame, vectors: DataFrame, reranked: DataFrame) -> DataFrame:
    """T-15, H-04: candidates that have a vector, with a preference score (one half without a profile's) and it as a probability."""
    rows = having(candidates.where("status = 'candidate'"), vectors).join(reranked.select("id", "final_score"), "id", "left")
    score = F.coalesce("final_score", F.lit(0.5))
    return rows.select("id", F.round(score, 6).alias("preference"), F.round(F.least(F.greatest(score, F.lit(0.01)), F.lit(0.99)), 6).alias("probability"))


def rescored(candidates: DataFrame, vectors: DataFrame, reranked: DataFrame, model: str, dim: int, version: str) -> DataFrame:
    """H-04: all candidates ``(id, status, base, final_score, profile_score, profile_version, ...)``, those of status ``candidate`` that
    have a base score and a vector ``(id, model, dim)`` of the model and dimension with their new scores and the profile's
    version, from ``reranked(id, final_score, profile_score)``; the others as they are."""
    mine = candidates.where("status = 'candidate' and base is not null").select("id").join(vectors.where((F.col("model") == model) & (F.col("dim") == dim)).select("id"), "id", "left_semi")
    new = mine.join(reranked.select("id", F.col("final_score").alias("__final"), F.col("profile_score").alias("__profile")), "id").select("id", "__final", "__profile", F.lit(True).alias("__new"))
    rows = candidates.join(new, "id", "left")
    pick = lambda fresh, old: F.when(F.col("__new"), fresh).otherwise(F.col(old)).alias(old)
    own = {"final_score": F.col("__final"), "profile_score": F.col("__profile"), "profile_version": F.lit(version)}
    return rows.select(*[pick(own[c], c) if c in own else F.col(c) for c in candidates.columns])


def with_scores(clips: DataFrame, scores: DataFrame) -> DataFrame:
    """Y-02: clips ``(id, base, ...)`` ranked by a score from a table of scores, or by ``base`` where it has none."""
    return clips.join(scores.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", "base"))


def fingerprint_duplicates(videos: DataFrame, tolerance: float = 2.0, distance: int = 5) -> DataFrame:
    """J-07: for each video ``(video, position, duration, phashes)`` that repeats an earlier one, the first such.

    Alike are videos of durations within ``tolerance`` and as many hashes, three at least, no pair of which differs in more than
    ``distance`` bits. A bad hash, or a duration that is null or not finite, is alike to none. Of equal positions the least video is named.

    Each video looks for others by the one of its hashes, with its place, that the fewest have or come near, and they are
    found under each of theirs: a frame that very many share, as a black one at the start, is the key of none that has a rarer one.
    """
    rows = videos.where((F.size("phashes") >= 3) & (F.abs("duration") < float("inf")))
    classes = rows.groupBy("phashes", "duration").agg(F.min(F.struct("position", "video")).alias("x")).select("phashes", "duration", F.col("x.position").alias("at"), F.col("x.video").alias("first"))
    shared_checkpoints(videos.sparkSession)
    classes = classes.withColumn("bits", F.transform("phashes", hash_bits)).where(F.forall("bits", lambda b: b.isNotNull()))
    classes = classes.withColumns({"class": F.monotonically_increasing_id(), "n": F.size("bits"), "slot": F.floor(F.col("duration") / max(tolerance, 1e-9)).cast("double")}).checkpoint()
    # Every class under each of its hashes; each distinct hash with those near it, itself too.
    held = classes.select("class", "n", "slot", "at", "first", "duration", "bits", F.posexplode("bits").alias("place", "hash"))
    hashes = held.select("hash").distinct()
    pairs = hamming_pairs(hashes.select(F.col("hash").alias("id"), F.col("hash").alias("bits")), distance).select("a", "b")
    near = pairs.union(pairs.select("b", "a")).union(hashes.select("hash", "hash")).toDF("hash", "other").checkpoint()
    load = held.groupBy("n", "place", "hash").agg(F.count("*").alias("classes"))
    load = near.join(load.withColumnRenamed("hash", "other"), "other").groupBy("n", "place", "hash").agg(F.sum("classes").alias("classes"))
    rarest = held.select("class", "n", "place", "hash").join(load, ["n", "place", "hash"]).groupBy("class").agg(F.min_by(F.struct("place", "hash"), F.struct("classes", "place")).alias("k"))
    asked = classes.join(rarest, "class").select("class", "n", "at", "duration", "bits", "k.*", F.explode(F.array(*(F.col("slot") + i for i in (-1, 0, 1)))).alias("slot")).join(near, "hash").drop("hash")
    other = held.select("n", "slot", "place", F.col("hash").alias("other"), F.col("at").alias("b_at"), F.col("first").alias("b_first"), F.col("duration").alias("b_duration"), F.col("bits").alias("b_bits"))
    far = F.array_max(F.zip_with("bits", "b_bits", hamming))
    alike = asked.join(other, ["n", "slot", "place", "other"]).where((F.col("b_at") <= F.col("at")) & (F.abs(F.col("duration") - F.col("b_duration")) <= tolerance) & (far <= distance))
    best = alike.groupBy("class").agg(F.min(F.struct("b_at", "b_first")).alias("x"))
    # A class is alike to itself: its later videos repeat its first, or what that repeats.
    best = classes.select("phashes", "duration", "class").join(best, "class").select("phashes", "duration", F.col("x.b_at").alias("earliest"), F.col("x.b_first").alias("duplicate_of"))
    return rows.join(best, ["phashes", "duration"]).where("earliest < position").select("video", "duplicate_of")


def apply_relinks(media: DataFrame, candidates: DataFrame, proposals: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J-14: the media and candidates after the confirmed proposals ``(id, old_path, new_path, digest, confirmed)``, and the outcome
    of each: ``dry run``, ``changed`` (the file's digest is another now), ``claimed`` (another medium has the path) or
    ``applied``, with the media and candidate paths that it rewrites."""
    owner = media.groupBy(F.col("path").alias("new_path")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    rows = proposals.join(scanned.select(F.col("path").alias("new_path"), F.col("digest").alias("actual")), "new_path", "left").join(owner, "new_path", "left")
    outcome = F.when(~F.coalesce("confirmed", F.lit(False)), "dry run").when(~F.col("digest").eqNullSafe(F.col("actual")), "changed").when((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")), "claimed").otherwise("applied")
    rows = rows.withColumn("outcome", outcome)
    moves = rows.where("outcome = 'applied'").select("id", "old_path", "new_path")
    moved = media.join(moves.select("id", F.col("new_path").alias("moved")), "id", "left").withColumn("path", F.coalesce("moved", "path")).drop("moved")
    paths, after = ["source_video_path", "artifact_path", "preview_path"], candidates
    used = reduce(lambda a, b: a.union(b), [candidates.select(F.col(c).alias("old_path")) for c in paths]).where("old_path is not null").groupBy("old_path").agg(F.count("*").alias("used"))
    for c in paths:
        to = moves.select(F.col("old_path").alias(c), F.col("new_path").alias("moved"))
        after = after.join(to, c, "left").withColumn(c, F.coalesce("moved", c)).drop("moved")
    hit = F.col("outcome") == "applied"
    report = rows.join(used, "old_path", "left").select("id", "outcome", F.when(hit, 1).otherwise(0).cast("long").alias("media_rows"), F.when(hit, F.coalesce("used", F.lit(0))).otherwise(0).cast("long").alias("candidate_paths"))
    return moved, after.select(candidates.columns), report


def holdout_report(judged: DataFrame, metrics: list[DataFrame], shared_sources: DataFrame, least: int = 30) -> DataFrame:
    """A-39: one row: judgments, whether they are enough and of sources that the profile has not seen, and the metrics, each a row."""
    facts = judged.agg(F.count("*").alias("judgments")).crossJoin(shared_sources.select(F.col("shared").alias("shared_sources")))
    reasons = F.concat_ws("; ", F.when(F.col("judgments") < least, "too few judgments"), F.when(F.col("shared_sources") > 0, "sources overlap"))
    return reduce(lambda a, b: a.crossJoin(b), metrics, facts.withColumns({"reasons": reasons, "ready": reasons == ""}))
