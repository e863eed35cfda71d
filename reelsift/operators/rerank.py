"""Preference profiles and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.functions.columns import clamp, cosine
from reelsift.operators.vectors import weighted_mean

#: Weights of the score's components, and the bounds for a scenario.
COMPONENTS = {"base": 0.55, "global_like": 0.25, "scenario_like": 0.15, "dislike": -0.20}
SCENARIO_TOTAL, SCENARIO_CONFIDENCE = 8, 0.25


def global_profile(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """A-19, A-22: one row: liked and disliked centroid of weighted events, and confidence min(1, n / 100)."""
    side = F.when(F.col("rating") == "dislike", "disliked").otherwise("liked")
    rows = events.join(vectors, events.target_id == vectors.id).withColumn("side", side)
    means = weighted_mean(rows, ["side"], weight=F.col("weight"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("mean"))).alias(s)
    return means.agg(pick("liked"), pick("disliked")).crossJoin(events.agg(F.least(F.lit(1.0), F.count("*") / 100).alias("confidence")))


def scenario_profiles(events: DataFrame, keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """A-21: for each scenario key of ``keys(id, key)`` with enough targets and a clear leaning: counts and liked centroid."""
    side = F.when(F.col("rating") == "dislike", "disliked").otherwise("liked")
    rows = events.join(keys, events.target_id == keys.id).withColumn("side", side).select("key", "target_id", "side").distinct()
    counts = rows.groupBy("key").agg(F.count_if(F.col("side") == "liked").alias("likes"), F.count_if(F.col("side") == "disliked").alias("dislikes"))
    total = F.col("likes") + F.col("dislikes")
    counts = counts.withColumn("confidence", F.abs(F.col("likes") - F.col("dislikes")) / total).where((total >= SCENARIO_TOTAL) & (F.col("confidence") >= SCENARIO_CONFIDENCE))
    liked = weighted_mean(rows.where("side = 'liked'").join(vectors, F.col("target_id") == F.col("id")), ["key"])
    return counts.join(liked.withColumnRenamed("mean", "centroid"), "key", "left")


def scenario_union(liked: DataFrame, disliked: DataFrame) -> DataFrame:
    """U-04: the scenario keys ``(key)`` of likes and of dislikes, once each."""
    return liked.select("key").union(disliked.select("key")).distinct()


def rerank(candidates: DataFrame, profile: DataFrame, scenarios: DataFrame, enabled: bool = True) -> DataFrame:
    """H-01 to H-03, J-10: candidates ``(id, vector, keys, base)`` with similarities, final score and profile score.

    Positive weights are scaled to a sum of 1 over what is available. Without a vector, without a row in ``profile`` (at most
    one) or with ``enabled`` false the base score stays. The reasons say what took no part: ``disabled``, ``no vector``,
    ``no profile``, ``no liked centroid``, ``no disliked centroid``, ``no keys``, ``no scenario``.
    """
    profile = profile.select("liked", "disliked", F.lit(True).alias("published")).limit(1 if enabled else 0)
    one = candidates.join(F.broadcast(profile), F.lit(True), "left")
    by_key = candidates.select("id", "vector", F.explode("keys").alias("key")).join(scenarios.where("centroid is not null").select("key", "centroid"), "key")
    near = by_key.groupBy("id").agg(F.avg(cosine(F.col("vector"), F.col("centroid"))).alias("scenario_like"))
    rows = one.join(near, "id", "left").withColumn("scenario_like", F.when(F.col("published"), F.col("scenario_like"))).withColumn("global_like", F.when(F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("liked")))).withColumn("dislike", F.when(F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("disliked"))))
    up = [c for c, w in COMPONENTS.items() if w > 0]
    have = sum((F.when(F.col(c).isNotNull(), COMPONENTS[c]).otherwise(0.0) for c in up), F.lit(0.0))
    gain = sum((F.coalesce(F.col(c) * COMPONENTS[c], F.lit(0.0)) for c in up), F.lit(0.0))
    raw = gain / have + F.coalesce(F.col("dislike") * COMPONENTS["dislike"], F.lit(0.0))
    parts = [(F.col("global_like") + 1) / 2, (F.col("scenario_like") + 1) / 2, (1 - F.col("dislike")) / 2]
    weights = [abs(COMPONENTS[c]) for c in ("global_like", "scenario_like", "dislike")]
    there = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in zip(parts, weights)), F.lit(0.0))
    profile_score = F.when(there > 0, sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(parts, weights)), F.lit(0.0)) / there)
    no = lambda c, why: F.when(c, F.lit(why))
    found, keyed = F.col("published").isNotNull(), F.coalesce(F.size("keys"), F.lit(0)) > 0
    why = F.array(
        no(F.lit(not enabled), "disabled"), no(F.col("vector").isNull(), "no vector"), no(F.lit(enabled) & ~found, "no profile"), no(found & F.col("liked").isNull(), "no liked centroid"),
        no(found & F.col("disliked").isNull(), "no disliked centroid"), no(~keyed, "no keys"), no(keyed & F.col("scenario_like").isNull(), "no scenario"),
    )
    reasons = F.array_compact(why)
    final = F.when(F.col("vector").isNull() | ~found, F.col("base")).otherwise(clamp(raw))
    r = lambda c: F.round(c, 6)
    return rows.select("id", r(F.col("base")).alias("base"), r(F.col("global_like")).alias("global_like"), r(F.col("scenario_like")).alias("scenario_like"), r(F.col("dislike")).alias("dislike"), r(profile_score).alias("profile_score"), r(final).alias("final_score"), F.array_join(reasons, "; ").alias("reasons"))
