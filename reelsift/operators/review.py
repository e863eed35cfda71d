"""Review queues and diverse or narrative selections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import cosine, min_max
from reelsift.operators.greedy import shared_checkpoints
from reelsift.operators.scans import Segments
from reelsift.operators.vectors import weighted_mean


def queues(rows: DataFrame, key: str, limit: int, ratios: tuple[float, float] = (0.7, 0.2), seed: int = 7) -> DataFrame:
    """T-12, T-14: a review queue for each ``key``: rows ``(id, key, source, score, probability)`` with ``explore``, or with
    ``cluster`` and ``vector``, from which T-13 takes it after the other choices. Returns the key, id and bucket.

    A queue holds ``limit`` rows, or all there are: int(n * ratio) of the best scored, then of the least certain, and the rest
    explored, an unseen source first. Earlier buckets exclude later ones; each id once, so that quotas always fill. Of a hot
    queue every task keeps no more rows than the limit before the shuffle.
    """
    rows = rows.dropDuplicates([key, "id"])
    sizes = rows.groupBy(key).agg(F.least(F.lit(limit), F.count("*")).alias("n")).select(F.col(key).alias("__key"), (F.col("n") * ratios[0]).cast("int").alias("n1"), (F.col("n") * ratios[1]).cast("int").alias("n2"), "n")
    shared_checkpoints(rows.sparkSession)
    rows = rows.join(sizes, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").checkpoint()
    most = [int(limit * ratios[0]) + 1, int(limit * ratios[1]) + 1, limit]

    def top(left: DataFrame, order: list, n, k: int, bucket: str) -> DataFrame:
        ranked = left.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= most[k])
        return ranked.where(F.col("__r") <= n).drop("__r").withColumn("bucket", F.lit(bucket)).checkpoint()

    def without(left: DataFrame, gone: DataFrame) -> DataFrame:
        gone = gone.select(F.col(key).alias("__key"), F.col("id").alias("__id"))
        return left.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.col("id") == F.col("__id")), "left_anti")

    best = top(rows, [F.desc("score"), F.col("id")], F.col("n1"), 0, "exploit")
    rest = without(rows, best)
    unsure = top(rest, [F.abs(F.col("probability") - 0.5), F.col("id")], F.col("n2"), 1, "uncertain")
    rest = without(rest, unsure)
    if "explore" not in rows.columns:
        taken = best.union(unsure).where("vector is not null")
        own, all_ = (weighted_mean(taken.withColumnRenamed(key, "__key"), ["__key", *more]) for more in (["cluster"], []))
        rest = rest.join(own.select(F.col("__key").alias("__k1"), F.col("cluster").alias("__c"), F.col("mean").alias("__own")), F.col(key).eqNullSafe(F.col("__k1")) & F.col("cluster").eqNullSafe(F.col("__c")), "left")
        rest = rest.join(all_.select(F.col("__key").alias("__k2"), F.col("mean").alias("__all")), F.col(key).eqNullSafe(F.col("__k2")), "left")
        gap = F.aggregate(F.zip_with("vector", F.coalesce("__own", "__all"), lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, x: s + x)
        rest = rest.withColumn("explore", F.coalesce(F.sqrt(gap), F.lit(0.0))).drop("__k1", "__k2", "__c", "__own", "__all")
    chance = F.xxhash64(F.lit(seed), "id")
    of_source = Window.partitionBy(key, "source").orderBy(F.desc("explore"), chance, "id")
    rest = rest.withColumn("__seen", F.row_number().over(of_source)).where(F.col("__seen") <= limit)
    explored = top(rest, [(F.col("__seen") > 1), F.desc("explore"), chance, F.col("id")], F.col("n") - F.col("n1") - F.col("n2"), 2, "explore")
    out = [x.select(key, "id", "bucket") for x in (best, unsure, explored)]
    return out[0].union(out[1]).union(out[2])


def queue(rows: DataFrame, limit: int, ratios: tuple[float, float] = (0.7, 0.2), seed: int = 7) -> DataFrame:
    """T-12: one review queue of all rows, by ``queues``."""
    return queues(rows.withColumn("queue", F.lit(0)), "queue", limit, ratios, seed).select("id", "bucket")


def explore_scores(rows: DataFrame, centroids: DataFrame, overall: DataFrame) -> DataFrame:
    """T-13: distance to the centroid of what is selected in the row's cluster, else of all that is selected, else 0."""
    near = rows.join(centroids.select("cluster", F.col("mean").alias("own")), "cluster", "left").crossJoin(F.broadcast(overall.select(F.col("mean").alias("all"))))
    gap = F.aggregate(F.zip_with("vector", F.coalesce("own", "all"), lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return near.select("id", F.round(F.coalesce(F.sqrt(gap), F.lit(0.0)), 6).alias("explore"))


def diverse_sets(rows: DataFrame, key: str, n: int, weight: float = 0.5) -> DataFrame:
    """T-16: of each ``key`` n rows of ``(id, score, vector)``: the best, then each time the one of highest score and distance to
    those chosen, with their rank. A missing vector is at distance 0 of all; of equal rows the one of least id is taken.

    Choices are made among the top max(5 n, 100) of a key by score, each key's in a task of its own: that pool is all that a
    task holds of a key.
    """
    pool = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where(F.col("__r") <= max(5 * n, 100))
    kind = rows.schema[key].dataType.simpleString()
    pool = pool.select(F.col(key).alias("k"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.col("vector").cast("array<double>").alias("vector"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids, score = frame["id"].to_numpy(), frame["score"].to_numpy()
        units = []
        for v in frame["vector"]:
            v = None if v is None else np.asarray(v, float)
            units.append(None if v is None else v / (np.linalg.norm(v) or 1.0))
        size = max((len(u) for u in units if u is not None), default=1)
        known = np.array([u is not None for u in units])
        table = np.stack([np.zeros(size) if u is None else u for u in units])
        near, open_, chosen = np.full(len(ids), np.inf), np.ones(len(ids), bool), []
        while open_.any() and len(chosen) < n:
            worth = (1 - weight) * score + weight * np.where(np.isinf(near), 0.0, near) if chosen else score
            at = int(np.argmax(np.where(open_, worth, -np.inf)))
            chosen.append(at)
            open_[at] = False
            near = np.minimum(near, np.where(known & known[at], 1 - table @ table[at], 0.0))
        return pd.DataFrame({"k": [frame["k"].iloc[0]] * len(chosen), "id": ids[chosen], "rank": range(1, len(chosen) + 1)})

    return pool.groupBy("k").applyInPandas(choose, f"k {kind}, id long, rank long").withColumnRenamed("k", key)


def farthest_first(rows: DataFrame, n: int, weight: float = 0.5) -> DataFrame:
    """T-16: one set of all rows, by ``diverse_sets``."""
    return diverse_sets(rows.withColumn("set", F.lit(0)), "set", n, weight).select("id", "rank")


def narrative(rows: DataFrame, beats: DataFrame) -> DataFrame:
    """T-17: for each beat in order, the best candidate of its collection not used yet; candidates ``(collection, id, source,
    quality, preference, vector)``, beats ``(collection, beat, vector)``.

    A beat is a round: fits are taken for all candidates where they lie, and a collection's best is a grouped maximum, so no task
    holds a collection. A missing vector, quality or preference counts as 0; of equal candidates the one of least id is taken.
    """

    def scaled(name: str) -> Column:
        return min_max(F.col(name), F.col(f"{name}_lo"), F.col(f"{name}_hi"))

    shared_checkpoints(rows.sparkSession)
    span = rows.groupBy("collection").agg(*[f(x).alias(f"{x}_{n}") for x in ("quality", "preference") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    left = rows.join(span, "collection").select("collection", "id", "source", "vector", (0.3 * scaled("quality") + 0.2 * scaled("preference")).alias("worth")).checkpoint()
    order = beats.withColumn("turn", F.row_number().over(Window.partitionBy("collection").orderBy("beat"))).checkpoint()
    used, out = None, None
    for turn in range(1, (order.agg(F.max("turn")).first()[0] or 0) + 1):
        wanted = order.where(F.col("turn") == turn).select("collection", "beat", F.col("vector").alias("wanted"))
        free = left.join(wanted, "collection")
        fresh = F.lit(0.1)
        if used is not None:
            free = free.join(used.select("collection", "id"), ["collection", "id"], "left_anti")
            free = free.join(used.select("collection", "source", F.lit(True).alias("seen")).distinct(), ["collection", "source"], "left")
            fresh = F.when(F.col("seen"), 0.0).otherwise(0.1)
        total = F.round(0.4 * F.coalesce(cosine(F.col("vector"), F.col("wanted")), F.lit(0.0)) + F.col("worth") + 0.1 * fresh, 9)
        best = free.select("collection", "id", "source", total.alias("total")).groupBy("collection").agg(F.max_by(F.struct("id", "source"), F.struct("total", -F.col("id"))).alias("x")).select("collection", "x.*").checkpoint()
        used = best if used is None else used.union(best)
        made = wanted.join(best, "collection", "left").select("collection", "beat", "id", F.when(F.col("id").isNull(), "no candidate left").alias("missing"))
        out = made if out is None else out.union(made)
    return out if out is not None else rows.sparkSession.createDataFrame([], "collection long, beat long, id long, missing string")


#: Rows on each side of a block of ``_first_near``, pivots of its cells at most, and rounds of ``near_keepers`` by batches.
BLOCK, PIVOTS, BATCHES = 4096, 256, 4


def near_keepers(rows: DataFrame, threshold: float, batch: int = 64) -> DataFrame:
    """T-08: for each of ``rows(id, grp, score, vector)``, each id once, the keeper that a pass through its group in order of
    score takes it for: itself, or the first kept row before it of a cosine of at least the threshold, with that ``similarity``.
    Rows without a vector, or with a component that is null or not finite, keep themselves and stand for no other; a null score
    or group is one like any other.

    The first ``BATCHES`` rounds each take the ``batch`` best open rows of every group, choose among them in order, and close
    what is near one chosen, which thins out dense groups. Of what is left, a round keeps the rows that have no open row near
    them before them, and closes what is near those: as many rounds as the longest chain of such rows, whatever the group's size.
    """
    shared_checkpoints(rows.sparkSession)
    whole = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = rows.select("id", "grp", "score", "vector", whole.alias("whole")).checkpoint()
    open_ = rows.where("whole").select("id", "grp", "score", F.transform("vector", lambda x: x.cast("double")).alias("vector")).checkpoint()
    alone = lambda x: x.select("id", F.col("id").alias("keeper"), F.lit(None).cast("double").alias("similarity"))
    out = alone(rows.where("not whole"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn")
        kept: list[int] = []
        units = []
        for i, v in enumerate(frame["vector"]):
            length = math.sqrt(sum(x * x for x in v))
            u = np.asarray(v) / length if length else np.zeros(len(v))
            if all(len(u) != len(w) or float(u @ w) < threshold for w in units):
                kept.append(i)
                units.append(u)
        return frame.iloc[kept][["id", "grp", "turn", "vector"]]

    order = Window.partitionBy("grp").orderBy(F.desc("score"), "id")
    for _ in range(BATCHES):
        if open_.isEmpty():
            return out
        first = open_.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= batch).select("id", "grp", "turn", "vector")
        kept = first.groupBy("grp").applyInPandas(choose, first.schema).checkpoint()
        chosen = kept.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "vector"))).alias("chosen"))
        rest = open_.join(kept.select("id"), "id", "left_anti").alias("r").join(chosen.alias("c"), F.col("r.grp").eqNullSafe(F.col("c.grp"))).select("r.*", "chosen")
        near = F.transform("chosen", lambda k: F.struct(k.id.alias("id"), cosine(F.col("vector"), k.vector).alias("s")))
        rest = rest.withColumn("hit", F.try_element_at(F.filter(near, lambda k: k.s >= threshold), F.lit(1))).drop("chosen").checkpoint()
        out = out.union(alone(kept))
        out = out.union(rest.where("hit is not null").select("id", F.col("hit.id").alias("keeper"), F.col("hit.s").alias("similarity")))
        open_ = rest.where("hit is null").drop("hit")
    if open_.isEmpty():
        return out
    placed = _placed(open_, threshold)
    left, kept = placed, None
    while not left.isEmpty():
        behind = _first_near(left, left, threshold).select("id")
        first = left.join(behind, "id", "left_anti").checkpoint()
        rest = left.join(first.select("id"), "id", "left_anti").checkpoint()
        left = rest.join(_first_near(rest, first, threshold).select("id"), "id", "left_anti").checkpoint()
        kept = first if kept is None else kept.union(first)
    # A row may be near an earlier keeper than the one that closed it: keepers are named when all are known.
    named = _first_near(placed.join(kept.select("id"), "id", "left_anti"), kept, threshold).checkpoint()
    return out.union(alone(kept)).union(named)


def _placed(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(id, key, late, low, vector, home, cells)``: their order within ``key``, a group's vectors of one length, as two
    numbers before the id; the cell that they lie in; and the cells that a vector near them can lie in.

    Cells are those of the nearest of a bounded set of pivots: rows picked by hash, one for each ``BLOCK`` rows of the largest
    group, ``PIVOTS`` at most. A vector x of pivot a has one of pivot b within r only if x.a - x.b <= r |a - b|, so none is missed.
    """
    score = F.col("score").cast("double")
    late = F.when(score.isNull(), 2).when(F.isnan(score), 0).otherwise(1)
    low = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(-score)
    rows = rows.select("id", F.to_json(F.struct("grp", F.size("vector").alias("n"))).alias("key"), late.alias("late"), low.alias("low"), "vector").checkpoint()
    most = rows.groupBy("key").count().agg(F.max("count")).first()[0]
    few = min(PIVOTS, most // BLOCK) if threshold > 0 else 0
    picked = [np.asarray(r[0]) for r in rows.orderBy(F.xxhash64("id")).limit(few).select("vector").toLocalIterator()] if few else []
    picked = [v / np.linalg.norm(v) for v in picked if len(v) == len(picked[0]) and np.linalg.norm(v) > 0]
    pivots = np.stack(picked) if picked else None
    # A little more than the radius, for rounding.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def place(frames):
        for f in frames:
            home, cells = np.zeros(len(f), int), [[0]] * len(f)
            mine = [i for i, v in enumerate(f["vector"]) if pivots is not None and len(v) == pivots.shape[1]]
            if mine:
                units = np.stack(f["vector"].iloc[mine].tolist())
                units = units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-300)
                near = units @ pivots.T
                at = near.argmax(axis=1)
                apart = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
                ok = near[np.arange(len(at)), at][:, None] - near <= reach * apart[at] + 1e-9
                for i, a, mask in zip(mine, at, ok):
                    home[i], cells[i] = a, np.flatnonzero(mask).tolist()
            yield f.assign(home=home, cells=cells)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(place, f"id {kind}, key string, late int, low double, vector array<double>, home int, cells array<int>").checkpoint()


def _first_near(rows: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """For each of ``rows`` the first of ``others`` before it in its key's order of a cosine of at least the threshold; both as
    ``_placed`` gives them. Returns ``(id, keeper, similarity)`` of those that have one.

    A cell's rows and others are cut in parts of about ``BLOCK``, and each task compares a part with a part by a product of
    matrices; a row gives one line for each such block, not one for each pair.
    """
    keys = ["key", "cell"]
    asked = rows.select("id", "key", "late", "low", "vector", F.explode("cells").alias("cell"))
    # Columns of their own: others may be the same table.
    held = others.select(*(F.col(c).alias(n) for c, n in zip(["id", "key", "late", "low", "vector", "home"], ["id", "key", "late", "low", "vector", "cell"])))
    parts = lambda x, name: x.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = parts(asked, "n").join(parts(held, "m"), keys)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(sizes, keys).withColumns({"i": own("n")}).withColumn("j", every("m")).drop("n", "m")
    held = held.join(sizes, keys).withColumns({"j": own("m")}).withColumn("i", every("n")).drop("n", "m")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        order = ["late", "low", "id"]
        b = b.sort_values(order, ignore_index=True)
        both = pd.concat([a[order].assign(own=True), b[order].assign(own=False)]) if len(a) and len(b) else None
        none = pd.DataFrame({"id": a["id"][:0], "late": a["late"][:0], "low": a["low"][:0], "keeper": b["id"][:0], "similarity": pd.Series([], dtype=float)})
        if both is None:
            return none
        # How many of b come before each of a: a row is not before itself.
        both["row"] = np.r_[np.arange(len(a)), np.arange(len(b))]
        both = both.sort_values([*order, "own"], ascending=[True, True, True, False], kind="stable")
        before = np.zeros(len(a), int)
        mine = both["own"].to_numpy()
        before[both["row"].to_numpy()[mine]] = np.cumsum(~mine)[mine]
        x, y = np.stack(a["vector"].tolist()), np.stack(b["vector"].tolist())
        # Sums in order of place, as a SQL aggregate takes them.
        length = lambda v: np.sqrt((v * v).cumsum(axis=1)[:, -1]) if v.shape[1] else np.zeros(len(v))
        nx, ny = length(x), length(y)
        found = []
        for lo in range(0, len(a), 256):
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (x[lo : lo + 256] @ y.T) / (nx[lo : lo + 256, None] * ny[None])
            s[~np.isfinite(s)] = 0.0
            s[np.arange(len(b))[None] >= before[lo : lo + 256, None]] = -np.inf
            for i, k in np.argwhere(np.abs(s - threshold) < 1e-9):
                n = nx[lo + i] * ny[k]
                s[i, k] = (x[lo + i] * y[k]).cumsum()[-1] / n if n > 0 else 0.0
            hit = s >= threshold
            at = hit.argmax(axis=1)
            found += [(lo + i, at[i]) for i in np.flatnonzero(hit.any(axis=1))]
        if not found:
            return none
        i, k = np.array(found).T
        n = nx[i] * ny[k]
        same = np.where(n > 0, (x[i] * y[k]).cumsum(axis=1)[:, -1] / np.where(n > 0, n, 1.0), 0.0)
        return pd.DataFrame({"id": a["id"].to_numpy()[i], "late": b["late"].to_numpy()[k], "low": b["low"].to_numpy()[k], "keeper": b["id"].to_numpy()[k], "similarity": same})

    kind = rows.schema["id"].dataType.simpleString()
    by = [*keys, "i", "j"]
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(meet, f"id {kind}, late int, low double, keeper {kind}, similarity double")
    best = met.groupBy("id").agg(F.min_by(F.struct("keeper", "similarity"), F.struct("late", "low", "keeper")).alias("k"))
    return best.select("id", "k.keeper", "k.similarity")


def duplicate_groups(keepers: DataFrame) -> DataFrame:
    """T-08: of each keeper that stands for others, their number and their greatest similarity to it."""
    return keepers.where("id <> keeper").groupBy("keeper").agg(F.count("*").alias("duplicates"), F.max("similarity").alias("max_similarity"))


def greedy_near(rows: DataFrame, threshold: float) -> DataFrame:
    """T-08: the rows that ``near_keepers`` keeps."""
    return rows.join(near_keepers(rows, threshold).where("id = keeper").select("id"), "id", "left_semi")


def even_stride(frames: DataFrame, n: int) -> DataFrame:
    """W-18: every (count // n)th frame of a video, the first n of them."""
    size = frames.groupBy(F.col("video").alias("__video")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("step"))
    rows = Segments(frames, ["video"], ["ts", "frame"]).add(rn=("count", "frame")).rows.withColumn("rn", F.col("rn") - 1)
    rows = rows.join(size, F.col("video").eqNullSafe(F.col("__video")))
    return rows.where((F.col("rn") % F.col("step") == 0) & (F.col("rn") / F.col("step") < n)).drop("step", "__video")
