"""Feedback events: resolution, status, profile gates and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.operators.digest import digests
from reelsift.operators.scans import Segments

RATINGS = ["like", "dislike", "neutral", "skip", "quality_reject", "favorite"]
#: The candidate status that a rating sets, and the weight of a rating in a profile.
STATUS = {"like": "liked", "dislike": "disliked", "neutral": "reviewed", "quality_reject": "rejected"}
WEIGHT = {"favorite": 2.0, "like": 1.0, "dislike": 1.0}


def chosen(key: Column, values: dict) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def expect(df: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """P-14: rows whose column is one of the values, and the others."""
    good = F.coalesce(F.col(column).isin(values), F.lit(False))
    return df.where(good), df.where(~good)


def effective(events: DataFrame, before=None) -> DataFrame:
    """R-01, J-04: events that are neither undone nor superseded, strictly before a time if one is given."""
    gone = events.where("supersedes_event_id is not null").select(F.col("supersedes_event_id").alias("event_id")).distinct()
    out = events.where("undone_at is null").join(gone, "event_id", "left_anti")
    return out if before is None else out.where(F.col("created_at") < before)


def latest(events: DataFrame, keys: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """W-01: the last event of each target, by time and id; a grouped maximum, so a hot target combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct("created_at", "event_id"))
    return events.groupBy(*keys).agg(pick.alias("x")).select(*keys, "x.*")


def profile_events(events: DataFrame, mode: str = "resolved") -> DataFrame:
    """W-02: the last like, dislike or favorite of each target. ``resolved`` first takes away superseded events; ``reference``
    takes away undone ones alone."""
    if mode not in ("resolved", "reference"):
        raise ValueError("mode is resolved or reference")
    kept = effective(events) if mode == "resolved" else events.where("undone_at is null")
    return latest(kept.where(F.col("rating").isin("like", "dislike", "favorite")))


def with_status(events: DataFrame, start: Column | str = "candidate") -> DataFrame:
    """W-03, W-16: status of the target after each event, and before it; ``start`` is its status before all, or a column of it."""
    sets = events.withColumn("__set", chosen(F.col("rating"), STATUS))
    runs = Segments(sets, ["target_id"], ["created_at", "event_id"]).add(__now=("last", "__set"), __before=("last_before", "__set")).rows
    return runs.withColumns({"status": F.coalesce("__now", F.lit(start)), "previous_status": F.coalesce("__before", F.lit(start))}).drop("__set", "__now", "__before")


def record(incoming: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-18: events to append, with the status of the target before each; refused ones, of an unknown or null rating; and the
    candidates ``(id, status)`` whose status changes. An unknown target has no status before its first rating that sets one."""
    good, bad = expect(incoming, "rating", RATINGS)
    known = candidates.select(F.col("id").alias("target_id"), F.col("status").alias("known"))
    rows = with_status(good.join(known, "target_id", "left"), F.col("known"))
    new = rows.withColumns({"event_kind": F.lit("feedback"), "supersedes_event_id": F.lit(None).cast("string")})
    last = latest(rows.where(F.col("rating").isin(list(STATUS)) & F.col("known").isNotNull()))
    changed = last.where(F.col("status") != F.col("known")).select(F.col("target_id").alias("id"), "status")
    return new.drop("known", "status"), bad, changed


def until(events: DataFrame, mark) -> tuple[DataFrame, DataFrame]:
    """Z-04: the events up to a watermark in event time, which a profile may learn from, and the later ones to hold it against.

    The watermark is a snapshot's, a value or a column of literals, not a stream's. An event without a time is in neither."""
    at = F.col("created_at")
    return events.where(at <= mark), events.where(at > mark)


def corrections(events: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-19: new events for corrections ``(event_id, rating, note, created_at)`` and those refused with a reason.

    An unknown event, one superseded already and all but the first correction of an event are refused. The new event copies
    the target and has no scenario keys.
    """
    first = wanted.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy("created_at", "rating")))
    known = events.select("event_id", "target_id", "source", F.lit(True).alias("known")).dropDuplicates(["event_id"])
    gone = events.where("supersedes_event_id is not null").select(F.col("supersedes_event_id").alias("event_id"), F.lit(True).alias("gone")).distinct()
    all_ = first.join(known, "event_id", "left").join(gone, "event_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown").when(F.col("gone").isNotNull(), "superseded").when(F.col("n") > 1, "repeated")
    all_ = all_.withColumn("reason", reason)
    new = all_.where("reason is null").select(F.concat(F.lit("fix_"), F.col("event_id").cast("string")).alias("event_id"), "target_id", "source", "rating", "note", "created_at", F.col("event_id").alias("supersedes_event_id"), F.array().cast("array<string>").alias("scenario_keys"))
    return new, all_.where("reason is not null").select("event_id", "rating", "reason")


def undo_last(events: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """S-20: the newest event that is no correction, neither undone nor superseded, of each ``per`` (of all without it), and
    the status that undoing it gives back to its target."""
    pick = F.max_by(F.struct("event_id", "target_id"), F.struct("created_at", "event_id"))
    last = effective(events).where("supersedes_event_id is null").groupBy(*per).agg(pick.alias("x")).where("x is not null").select(*per, "x.*")
    before = with_status(events.join(last.select("target_id").distinct(), "target_id", "left_semi"))
    return last.join(before.select("event_id", F.col("previous_status").alias("status")), "event_id")


def tag_list(text: Column) -> Column:
    """S-23: tags written with commas between them, trimmed, without empty ones; null gives none."""
    return F.coalesce(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def comparisons(pairs: DataFrame) -> DataFrame:
    """S-21: a like for the winner and a dislike for the loser of each comparison."""
    both = F.array(F.struct(F.col("winner").alias("target_id"), F.lit("like").alias("rating"), F.concat(F.lit("over "), F.col("loser").cast("string")).alias("note")), F.struct(F.col("loser").alias("target_id"), F.lit("dislike").alias("rating"), F.concat(F.lit("under "), F.col("winner").cast("string")).alias("note")))
    return pairs.select("pair_id", F.explode(both).alias("x")).select("pair_id", "x.*")


def favorites(events: DataFrame) -> DataFrame:
    """S-22: the first favorite of each target."""
    return events.where("rating = 'favorite'").groupBy("target_id").agg(F.min_by("event_id", F.struct("created_at", "event_id")).alias("event_id"), F.min("created_at").alias("created_at"))


def gates(events: DataFrame) -> DataFrame:
    """A-15 to A-17: counts over the profile's events, the watermark, and the reasons against a build."""
    by_source = events.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("rating") != "dislike").alias("liked"), F.max("created_at").alias("t"))
    row = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("effective"), F.coalesce(F.sum("liked"), F.lit(0)).alias("positive"), F.count("*").alias("sources"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.max("t").alias("watermark"))
    row = row.withColumn("negative", F.col("effective") - F.col("positive")).withColumn("max_share", F.round(F.when(F.col("effective") > 0, F.col("most") / F.col("effective")).otherwise(0.0), 6))
    rules = [("effective < 30", "too few events"), ("positive < 15", "too few likes"), ("negative < 10", "too few dislikes"), ("sources < 3", "too few sources"), ("max_share > 0.4", "one source dominates")]
    reasons = F.array_compact(F.array(*(F.when(F.expr(r), F.lit(s)) for r, s in rules)))
    return row.select("effective", "positive", "negative", "sources", "max_share", "watermark", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("ready"))


def vector_gates(events: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """A-15: of the profile's events, targets with a vector of ``vectors(id, model, dim)``, and the reasons against a build: no
    vectors at all, another model or dimension than wanted, or targets without a vector."""
    fits = (F.col("model") == model) & (F.col("dim") == dim)
    found = vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.bool_and(F.col("model") == model), F.lit(False)).alias("model_ok"), F.coalesce(F.bool_and(F.col("dim") == dim), F.lit(False)).alias("dim_ok"))
    targets = events.select(F.col("target_id").alias("id")).distinct()
    covered = targets.join(vectors.where(fits).select("id"), "id", "left_semi").agg(F.count("*").alias("covered"))
    row = targets.agg(F.count("*").alias("targets")).crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(found))
    none, both = F.col("vectors") == 0, F.col("model_ok") & F.col("dim_ok")
    why = F.array(
        F.when(none, F.lit("no vectors")), F.when(~none & ~F.col("model_ok"), F.lit("another model")), F.when(~none & ~F.col("dim_ok"), F.lit("another dimension")),
        F.when(both & (F.col("covered") < F.col("targets")), F.lit("targets without a vector")),
    )
    return row.select("targets", F.when(both, F.col("covered")).otherwise(0).cast("long").alias("covered"), F.array_join(F.array_compact(why), "; ").alias("vector_reasons"))


def profile_preview(events: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """A-15: whether a build on the profile's events would pass: the gates on counts and those on vectors in one row."""
    row = gates(events).crossJoin(F.broadcast(vector_gates(events, vectors, model, dim)))
    reasons = F.concat_ws("; ", F.nullif("reasons", F.lit("")), F.nullif("vector_reasons", F.lit("")))
    return row.withColumn("reasons", reasons).withColumn("ready", F.col("reasons") == "").drop("vector_reasons")


def weighted(events: DataFrame, half_life_days: float = 30.0, recency: bool = True) -> DataFrame:
    """A-18: each event's weight: by rating, halved each half-life before the last event."""
    mark = events.agg(F.max("created_at").alias("mark"))
    age = (F.unix_micros("mark") - F.unix_micros("created_at")) / 86_400e6
    fade = F.pow(F.lit(0.5), age / half_life_days) if recency else F.lit(1.0)
    return events.crossJoin(F.broadcast(mark)).withColumn("weight", chosen(F.col("rating"), WEIGHT) * fade).drop("mark")


def tag_weights(tags: DataFrame) -> DataFrame:
    """A-20: how often each tag occurs over ``(id, tags)``, over the most frequent one's count."""
    counts = tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select("tag", "n", F.round(F.col("n") / F.col("most"), 6).alias("weight"))


def profile_version(events: DataFrame, model: str, dim: int, config: str) -> DataFrame:
    """A-23: an id from model, dimension, watermark, targets and settings. The targets enter as one digest of them all (``digests``)."""
    targets = digests(events.select("target_id").distinct(), ["target_id"])
    row = targets.crossJoin(F.broadcast(events.agg(F.max("created_at").alias("t"))))
    parts = F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.unix_micros("t").cast("string"), "digest", F.lit(config))
    return row.select(F.concat(F.lit("profile_"), F.substring(F.sha2(parts, 256), 1, 16)).alias("profile_version"))
