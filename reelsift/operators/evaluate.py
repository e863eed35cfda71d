"""Evaluation of rankings and calibration of scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsift.operators.greedy import shared_checkpoints
from reelsift.operators.scans import PART, Segments, first_at_or_above


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """A-26: mean score, share of positives and count in equal bins of [0, 1], with the empty ones."""
    b = F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    stats = rows.groupBy(b.alias("bin")).agg(F.avg("score").alias("s"), F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(stats, "bin", "left").select("bin", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("mean_score"), F.round(F.coalesce("p", F.lit(0.0)), 6).alias("positive_rate"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def auc(rows: DataFrame, buckets: int = 64) -> DataFrame:
    """A-28: share of (positive, negative) pairs in which the positive scores higher; ties don't count; 0.5 if a class is empty.

    Negatives below a score are summed within ranges of scores and over the ranges, not in one window.
    """
    each = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).withColumn("b", F.floor(F.col("score") * buckets))
    before = each.groupBy("b").agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("b")) - F.col("all")).select("b", "before")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = each.withColumn("below", below).join(before, "b").agg(F.sum(F.col("p") * (F.col("below") + F.col("before"))).alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).otherwise(0.5), 6).alias("auc"), F.coalesce("p", F.lit(0)).alias("positives"), F.coalesce("n", F.lit(0)).alias("negatives"))


def order_statistics(rows: DataFrame, keys: list[str], wanted: DataFrame, bins: int = 256) -> DataFrame:
    """The value ``score`` at each ``rank`` (from 0) of a group that ``wanted(*keys, rank, lo, hi)`` asks for; lo and hi bound the group.

    A pass counts the scores of the open ranges in ``bins`` bins, of all groups and ranks at once, and goes on in the bin that
    holds the rank; of each bin the least and greatest score that are there are known, so that a range closes on one value. No
    task or row ever holds the scores of a group.
    """
    shared_checkpoints(rows.sparkSession)
    named = [F.col(k).alias(f"__{k}") for k in keys]
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    scores = rows.select(*keys, F.col("score").cast("double").alias("score")).where("score is not null")
    open_ = wanted.select(*named, F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("left"), "lo", "hi").checkpoint()
    done = None
    while True:
        ready = open_.where("lo = hi").select(*[F.col(f"__{k}").alias(k) for k in keys], "rank", F.col("lo").alias("score"))
        done = ready if done is None else done.union(ready)
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            return done
        # A range's bins by halves of the range cannot overflow, and rise with the score, whatever the rounding.
        bin_ = F.least(F.floor((F.col("score") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        ranges = open_.select(*[f"__{k}" for k in keys], "lo", "hi").distinct()
        counts = scores.join(ranges, same & (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))).groupBy(*[f"__{k}" for k in keys], "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))
        w = Window.partitionBy(*[f"__{k}" for k in keys], "lo", "hi").orderBy("bin")
        counts = counts.withColumn("upto", F.sum("n").over(w)).select(*[F.col(f"__{k}").alias(f"k_{k}") for k in keys], F.col("lo").alias("k_lo"), F.col("hi").alias("k_hi"), "n", "upto", "least", "most")
        hit = reduce(lambda x, y: x & y, [F.col(f"__{k}").eqNullSafe(F.col(f"k_{k}")) for k in keys], (F.col("lo") == F.col("k_lo")) & (F.col("hi") == F.col("k_hi")) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        open_ = open_.join(counts, hit).select(*[f"__{k}" for k in keys], "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("least").alias("lo"), F.col("most").alias("hi")).checkpoint()


def describe(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A-29: least, greatest, mean, and exact quartiles by linear interpolation, of each group's scores."""
    shared_checkpoints(rows.sparkSession)
    r = lambda c, name: F.round(c, 6).alias(name)
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("score").alias("m"), F.min("score").cast("double").alias("lo"), F.max("score").cast("double").alias("hi"), F.avg("score").alias("mean")).checkpoint()
    places = stats.where("m > 0").select(*keys, "lo", "hi", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("m") - 1)).alias("at")) for q in (0.25, 0.5, 0.75)])).alias("p")).select(*keys, "lo", "hi", "p.*")
    ranks = places.select(*keys, "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    values = order_statistics(rows, keys, ranks).withColumnsRenamed({k: f"v_{k}" for k in keys})
    of = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"v_{k}")) for k in keys], F.lit(True))
    near = places.join(values, of & ((F.col("rank") == F.floor("at")) | (F.col("rank") == F.ceil("at"))))
    ends = near.groupBy(*keys, "q", "at").agg(F.min_by("score", "rank").alias("a"), F.max_by("score", "rank").alias("b"))
    value = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    quartiles = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, value)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]).withColumnsRenamed({k: f"w_{k}" for k in keys})
    out = stats.join(quartiles, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys]), "left")
    return out.select(*keys, "n", r(F.col("lo"), "least"), r(F.col("hi"), "greatest"), r(F.col("mean"), "mean"), r(F.col("q25"), "p25"), r(F.col("q50"), "median"), r(F.col("q75"), "p75"))


def _hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The corners of each group's points, which come in order; only corners are held."""
    group, corners = None, []
    for rows in batches:
        for g, k, s in zip(rows["g"].tolist(), rows["k"].tolist(), rows["s"].tolist()):
            if g != group:
                if corners:
                    yield pd.DataFrame({"g": group, "k": [x for x, _ in corners], "s": [y for _, y in corners]})
                group, corners = g, []
            corners.append((k, s))
            while len(corners) > 2 and (corners[-2][1] - corners[-3][1]) * (k - corners[-2][0]) >= (s - corners[-2][1]) * (corners[-2][0] - corners[-3][0]):
                corners.pop(-2)
    if corners:
        yield pd.DataFrame({"g": group, "k": [x for x, _ in corners], "s": [y for _, y in corners]})


def calibrator(rows: DataFrame, parts: int | None = None, fan: int = 16) -> DataFrame:
    """A-27: right edges, values and sizes of the pools of an isotonic step function of integer labels; equal scores are one point.

    Pools are what lies between neighbouring points at which the running sum of labels touches the greatest convex function
    below it, so that equal neighbours stay apart. Each range of scores gives the corners of its own; those of ``fan`` ranges
    merge, until one set is left: with n points about n ** (2/3) corners at most. Which points lie on a side of it is decided
    by an as-of join.
    """
    shared_checkpoints(rows.sparkSession)
    points = rows.where("score is not null and label is not null").groupBy("score").agg(F.count("*").alias("c"), F.sum(F.col("label").cast("long")).alias("y"))
    placed = Segments(points, [], ["score"], parts).add(k=("sum", "c"), s=("sum", "y"))
    points = placed._rows.checkpoint()
    sets = points.select(F.col(PART).alias("g"), "k", "s")
    hull, n = sets.repartition("g").sortWithinPartitions("g", "k").mapInPandas(_hulls, "g int, k long, s long"), (points.agg(F.max(PART)).first()[0] or 0) + 1
    while n > 1:
        hull, n = hull.select(F.floor(F.col("g") / fan).cast("int").alias("g"), "k", "s").repartition("g").sortWithinPartitions("g", "k").mapInPandas(_hulls, "g int, k long, s long").checkpoint(), -(-n // fan)
    # The origin is the first corner of all.
    origin = rows.sparkSession.createDataFrame([(0, 0, 0)], "g int, k long, s long")
    hull = hull.select(F.lit(0).alias("g"), "k", "s").union(origin).repartition("g").sortWithinPartitions("g", "k").mapInPandas(_hulls, "g int, k long, s long").checkpoint()
    sides = Segments(hull, [], ["k"]).add(before=("lag", F.struct("k", "s"))).rows.where("before is not null")
    events = points.select("k", F.struct("score", "s").alias("point"), F.lit(None).cast("struct<k0:bigint,s0:bigint,k1:bigint,s1:bigint>").alias("side"))
    events = events.union(sides.select("k", F.lit(None).cast(points.select(F.struct("score", "s")).schema[0].dataType).alias("point"), F.struct(F.col("before.k").alias("k0"), F.col("before.s").alias("s0"), F.col("k").alias("k1"), F.col("s").alias("s1"))))
    met = Segments(events, [], [F.desc("k"), F.col("point").isNotNull()]).add(on=("last", "side")).rows.where("point is not null")
    touches = (F.col("point.s") - F.col("on.s0")) * (F.col("on.k1") - F.col("on.k0")) == (F.col("on.s1") - F.col("on.s0")) * (F.col("k") - F.col("on.k0"))
    pools = met.where(touches).select("k", F.col("point.score").alias("edge"), ((F.col("on.s1") - F.col("on.s0")) / (F.col("on.k1") - F.col("on.k0"))).alias("value"))
    pools = Segments(pools, [], ["k"]).add(last=("lag", "k")).rows
    return pools.select("edge", "value", (F.col("k") - F.coalesce("last", F.lit(0))).alias("n"))


def calibrated(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """H-09: the value at the first edge not below the score, else the last value."""
    last = steps.agg(F.max("value").alias("__last"))
    hit = first_at_or_above(rows, "score", steps, "edge", "value", "__value")
    return hit.crossJoin(F.broadcast(last)).withColumn("probability", F.when(F.col("score").isNotNull(), F.coalesce("__value", "__last"))).drop("__value", "__last")


def strategy(rows: DataFrame) -> DataFrame:
    """A-30: how to turn scores ``(score, label)`` into decisions, from the share of points that the calibrator merges, the gap in
    the bin about one half, the range of scores and the mean gap of the bins that have rows. Equal scores are one point."""
    total = rows.agg(F.count("*").alias("n"), F.count_distinct("score").alias("points"), (F.max("score") - F.min("score")).alias("span"))
    pools = calibrator(rows).agg(F.count("*").alias("pools"))
    curve = reliability(rows).where("n > 0").withColumn("gap", F.abs(F.col("mean_score") - F.col("positive_rate")))
    facts = curve.agg(F.avg("gap").alias("off"), F.max(F.when(F.col("bin") == 5, F.col("gap"))).alias("middle"))
    merged = 1 - F.col("pools") / F.greatest("points", F.lit(1))
    advice = (
        F.when(F.col("n") < 10, "fixed-threshold (insufficient data for reliable calibration)").when(merged > 0.3, "monotonic-calibration")
        .when(F.coalesce(F.col("middle") < 0.15, F.lit(False)), "fixed-threshold").when(F.col("span") < 0.3, "percentile-threshold").when(F.col("off") < 0.2, "fixed-threshold").otherwise("monotonic-calibration")
    )
    one_row = total.crossJoin(F.broadcast(pools)).crossJoin(F.broadcast(facts))
    return one_row.select("n", "pools", F.round(merged, 6).alias("merge_ratio"), F.round("off", 6).alias("miscalibration"), advice.alias("advice"))


def ndcg(rows: DataFrame, keys: list[str], k: int, linear: bool = False) -> DataFrame:
    """A-31, A-32: NDCG at k of each group of ``(rank order columns score and id, relevance)``."""
    gain = F.col("relevance") if linear else F.pow(F.lit(2.0), F.col("relevance")) - 1
    given = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ideal = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "id")
    both = rows.withColumn("g", gain.cast("double")).withColumn("a", F.row_number().over(given)).withColumn("b", F.row_number().over(ideal))
    part = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col("g") / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    return both.groupBy(*keys).agg(part("a").alias("dcg"), part("b").alias("best")).select(*keys, F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"))


def at_top(ranked: DataFrame, judged: DataFrame, k: int = 20) -> DataFrame:
    """A-33, W-04: liked of the first k over all liked, and disliked of the first k over k."""
    top = ranked.orderBy(F.desc("score"), "id").limit(k).select("id")
    hits = top.join(judged, "id").agg(F.count_if(F.col("rating") == "like").alias("l"), F.count_if(F.col("rating") == "dislike").alias("d"))
    liked = judged.agg(F.count_if(F.col("rating") == "like").alias("all"))
    return hits.crossJoin(liked).select(F.round(F.when(F.col("all") > 0, F.col("l") / F.col("all")).otherwise(0.0), 6).alias("like_at_k"), F.round(F.col("d") / k, 6).alias("dislike_at_k"))


def global_rank(rows: DataFrame, score: str, id_: str = "id", name: str = "rank") -> DataFrame:
    """W-04: rows with their rank among all by score, best first, equal scores by id; a null score comes last.

    Rows are dealt out in ranges of score and id, ranked within their range and behind the ranges before: ties are split like
    the rest, and one window spans the ranges alone. The ranges are written, so that all that follows sees the same ones.
    """
    shared_checkpoints(rows.sparkSession)
    order = (F.desc_nulls_last(score), F.col(id_))
    dealt = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__at", inside).join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__at") + F.col("__before")).cast("long").alias(name))


def win_rate(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """A-34: share of liked rows that rank higher by ``preference`` than by ``base``, among all rows."""
    liked = judged.where("rating = 'like'").select("id")
    ranked = lambda score, name: global_rank(rows.select("id", score), score, name=name).select("id", name)
    both = liked.join(ranked("base", "r1"), "id").join(ranked("preference", "r2"), "id")
    return both.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col("r2") < F.col("r1")).cast("double")), F.lit(0.0)), 6).alias("win_rate"))


def exploration(rows: DataFrame) -> DataFrame:
    """A-35: rows, distinct sources and distinct scenario keys."""
    keys = rows.select(F.explode("keys").alias("k")).agg(F.count_distinct("k").alias("scenarios"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")).crossJoin(keys)


def shares(judged: DataFrame, vectors: DataFrame, scored: DataFrame) -> DataFrame:
    """A-36, A-37: share of judged rows with a vector, and those scored or with a base score alone."""
    rows = judged.select("id").join(vectors.select("id").distinct().withColumn("v", F.lit(1)), "id", "left").join(scored.select("id", "final"), "id", "left")
    return rows.agg(F.count("*").alias("judged"), F.round(F.count("v") / F.count("*"), 4).alias("coverage"), F.count("final").alias("scored"), F.count_if(F.col("final").isNull()).alias("base_only"))


def source_overlap(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """A-38, J-22, U-03: sources of training, of holdout, and of both; holdout rows from training sources."""
    a, b = train.select("source").distinct(), holdout.select("source").distinct()
    rows = holdout.join(a, "source", "left_semi").agg(F.count("*").alias("shared_rows"))
    return a.agg(F.count("*").alias("train")).crossJoin(b.agg(F.count("*").alias("holdout"))).crossJoin(a.intersect(b).agg(F.count("*").alias("shared"))).crossJoin(rows)
