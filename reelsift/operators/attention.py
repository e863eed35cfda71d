"""What needs attention: the sources of the inbox, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import readable_error

#: The columns of an item.
ITEM = ["attention_id", "kind", "severity", "title", "detail", "action_label", "action_target", "created_at"]
#: Ids of copies that the detail of a digest names at most; ``copies`` has them all.
NAMED = 100


def stable_id(kind: Column, key: Column) -> Column:
    """U-01: ``att_`` and the first 16 hex digits of the sha256 of kind and key."""
    return F.concat(F.lit("att_"), F.substring(F.sha2(F.concat(kind, F.lit(":"), key), 256), 1, 16))


def _text(form: str, *parts) -> Column:
    """The form with each {} replaced by a column as text; a null is shown as nothing."""
    pieces = form.split("{}")
    filled = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(pieces[0]), *(x for f, p in zip(filled, pieces[1:]) for x in (f, F.lit(p))))


def _items(rows: DataFrame, kind: str, severity: str, key: Column, title: Column, detail: Column, label: str, target: Column, order: list, limit: int | None) -> DataFrame:
    made = rows.orderBy(*order).limit(limit) if limit is not None else rows
    columns = [stable_id(F.lit(kind), key), F.lit(kind), F.lit(severity), title, detail, F.lit(label), target, F.col("created_at").cast("timestamp")]
    return made.select(*(c.alias(n) for c, n in zip(columns, ITEM)))


# The titles, details, labels and targets of items.


def job_failures(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """U-01: jobs ``(job_id, directory, status, created_at)`` that need attention, the newest ``limit`` of them."""
    rows = jobs.where("status = 'needs_attention'")
    return _items(rows, "task_failure", "error", _text("job:{}", "job_id"), _text("Task job needs attention: {}", "directory"), _text("Job {} is in 'needs_attention' status.", "job_id"), "View Job", _text("/api/tasks/jobs/{}", "job_id"), [F.desc("created_at"), "job_id"], limit)


def stage_failures(stages: DataFrame, videos: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """U-01, J-21, X-13: stages ``(stage_id, video_id, stage_name, status, last_error, created_at)`` that need attention, with the
    job of their video ``(video_id, job_id)`` and a readable error; those of no known video or job are left out."""
    rows = stages.where("status = 'needs_attention'").select("stage_id", "video_id", "stage_name", "last_error", "created_at")
    rows = rows.join(videos.select("video_id", "job_id"), "video_id").join(jobs.select("job_id"), "job_id", "left_semi")
    return _items(rows, "task_failure", "warning", _text("stage:{}", "stage_id"), _text("Stage '{}' needs attention", "stage_name"), readable_error(F.col("last_error")), "View Job", _text("/api/tasks/jobs/{}", "job_id"), [F.desc("created_at"), "stage_id"], limit)


def copies(media: DataFrame) -> DataFrame:
    """A-06: all media ``(media_id, sha256, created_at)`` of a digest that others have too, a row each."""
    many = media.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.min("created_at").alias("first")).where("n > 1")
    return media.join(many, "sha256").select("sha256", "media_id", "n", "first")


def duplicate_media(media: DataFrame, limit: int | None = None) -> DataFrame:
    """U-01, A-06: digests of several media, those of most copies first. The detail names the least ``NAMED`` ids, so that a digest
    which very many share is no row without bound."""
    w = Window.partitionBy("sha256").orderBy("media_id")
    first = copies(media).withColumn("r", F.row_number().over(w)).where(F.col("r") <= NAMED)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("media_id")), lambda x: x.cast("string")), ",")
    rows = first.groupBy("sha256").agg(F.first("n").alias("n"), F.first("first").alias("created_at"), ids.alias("ids"))
    rows = rows.withColumn("ids", F.when(F.col("n") > NAMED, F.concat("ids", F.lit(",..."))).otherwise(F.col("ids")))
    detail = _text("SHA256 {}... appears in {} media records. Media IDs: {}", F.substring("sha256", 1, 16), "n", "ids")
    return _items(rows, "migration_conflict", "warning", _text("sha256:{}", "sha256"), _text("Duplicate media ({} copies)", "n"), detail, "Resolve", _text("/api/workbench/conflicts?sha256={}", "sha256"), [F.desc("n"), F.desc("created_at"), "sha256"], limit)


def profile_publishes(log: DataFrame, limit: int | None = None) -> DataFrame:
    """U-01: publications ``(publication_id, version, previous, created_at)`` of profiles, the newest first."""
    later = F.coalesce(F.col("previous"), F.lit("")) != ""
    title = F.when(later, _text("Profile published: {} -> {}", "previous", "version")).otherwise(_text("Initial profile published: {}", "version"))
    detail = F.when(later, _text("Preference profile was updated from {} to {} and is now active.", "previous", "version")).otherwise("The first preference profile has been published and is now active.")
    return _items(log, "profile_publish", "info", _text("pub:{}", "publication_id"), title, detail, "View Profile", _text("/api/preference/profile/{}", "version"), [F.desc("created_at"), "publication_id"], limit)


def high_value_reviews(candidates: DataFrame, limit: int | None = None, least: float = 0.7) -> DataFrame:
    """U-01, T-05: candidates ``(id, source_video_path, status, final_score, created_at)`` to review of at least the score, the best first."""
    rows = candidates.where((F.col("status") == "candidate") & (F.col("final_score") >= least))
    score = F.call_function("format_number", F.col("final_score"), F.lit("0.00"))
    return _items(rows, "high_value_review", "info", _text("cand:{}", "id"), _text("High-value candidate: score {}", score), _text("Candidate {} from {} scored {} and awaits review.", "id", "source_video_path", score), "Review", _text("/api/candidates/{}", "id"), [F.desc("final_score"), "id"], limit)


def champion_promotions(log: DataFrame, limit: int | None = None) -> DataFrame:
    """U-01: promotions of a log ``(event_id, config, action, created_at)``, the newest first."""
    rows = log.where("action = 'promote'")
    return _items(rows, "champion_promotion", "info", _text("event:{}", "event_id"), _text("Champion config promoted: {}", "config"), _text("Configuration {} was promoted to champion.", "config"), "View History", F.lit("/api/quality/champions/history"), [F.desc("created_at"), "event_id"], limit)


def attention(sources: list[DataFrame], limit: int | None = 100) -> DataFrame:
    """U-01: items of all sources, errors first, then warnings, the newest of each first; a missing time is before all others. At most
    ``limit``, for which each source needs no more than that many of its own."""
    rows = reduce(lambda a, b: a.unionByName(b), sources)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = rows.orderBy(rank, F.desc(F.coalesce("created_at", F.timestamp_seconds(F.lit(0)))), "attention_id")
    return rows if limit is None else rows.limit(limit)
