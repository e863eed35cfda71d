"""Quality gates on model annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.functions.columns import canonical_emotion, placeholders, strip


def _errors(*rules: tuple[Column, str], by: str = "; ") -> Column:
    """The messages of the rules that hold, as one text."""
    return F.array_join(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(m)) for r, m in rules)), by)


def frame_gate(frames: DataFrame) -> DataFrame:
    """P-15, X-11: cleaned ``(id, caption, emotion, notes, why, worth)`` with the errors found and a status.

    A placeholder or blank text is an error and becomes empty; notes that are blank, placeholders or under 8 characters are left
    out. A missing emotion is ``other`` and a missing worth stays missing, both without an error; missing notes are one.
    """
    bad = lambda c: F.size(placeholders(c)) > 0
    caption, why, raw = strip(F.coalesce("caption", F.lit(""))), strip(F.coalesce("why", F.lit(""))), strip(F.coalesce("emotion", F.lit("")))
    notes = F.transform(F.coalesce("notes", F.array().cast("array<string>")), strip)
    clean, emotion = F.filter(notes, lambda n: (F.length(n) >= 8) & ~bad(n)), canonical_emotion(raw)
    errors = _errors(
        (bad(caption), "caption placeholder"), (~bad(caption) & (F.length(caption) < 8), "caption short"), (raw.rlike("[|,]"), "several emotions"),
        ((raw != "") & (emotion == "other") & (F.lower(raw) != "other"), "unknown emotion"), (F.col("notes").isNull(), "no notes"),
        (F.exists(notes, bad), "note placeholder"), (F.exists(notes, lambda n: ~bad(n) & (F.length(n) < 8)), "note short"), (F.size(clean) < 2, "few notes"),
        (bad(why), "why placeholder"), (~bad(why) & (F.length(why) < 12), "why short"), ((F.col("worth") < 0) | (F.col("worth") > 1), "worth range"),
    )
    kept = lambda c: F.when(bad(c), "").otherwise(c)
    return frames.select(
        "id", kept(caption).alias("caption"), emotion.alias("emotion"), F.array_join(clean, "|").alias("notes"), kept(why).alias("why"), F.round("worth", 6).alias("worth"),
        errors.alias("errors"), F.when(errors == "", "passed").otherwise("quality_failed").alias("status"),
    )


def media_gate(media: DataFrame) -> DataFrame:
    """P-16, P-17: errors of media annotations ``(id, caption, notes, why, tags, worth, reason)``."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    errors = _errors(
        (F.coalesce(F.length(F.trim("caption")), F.lit(0)) < 8, "caption"), (~size("notes").between(2, 4), "notes"), (F.coalesce(F.length(F.trim("why")), F.lit(0)) < 12, "why"),
        (~size("tags").between(1, 8), "tags"), (F.col("worth").isNull() | ~F.col("worth").between(0, 1), "worth"), (F.coalesce(F.length(F.trim("reason")), F.lit(0)) < 8, "reason"), by=";",
    )
    return media.select("id", errors.alias("errors"), (errors == "").alias("ok"))


def manifest_gate(rows: DataFrame, schema: str, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """P-13: all columns of manifests ``(stage, raw)`` and their errors: struct of schema_version, stage, clip_count, clips(clip_id)."""
    m = rows.withColumn("m", F.from_json("raw", schema))
    ids = F.transform("m.clips", lambda c: c.clip_id)
    errors = _errors(
        (F.col("m").isNull() | F.col("m.schema_version").isNull(), "unreadable"), (~F.col("m.schema_version").isin(*versions), "version"), (F.col("m.stage") != F.col("stage"), "stage"),
        (F.col("m.clip_count") != F.size("m.clips"), "count"), (F.size(F.filter(ids, lambda x: x.isNull() | (F.trim(x) == ""))) > 0, "empty id"), (F.size(F.array_distinct(ids)) != F.size(ids), "repeated id"),
    )
    return m.select(*rows.columns, errors.alias("errors"))
