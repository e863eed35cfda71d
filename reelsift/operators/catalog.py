"""Media catalog: duplicates, clusters, labels and relinks."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import hamming
from reelsift.operators.greedy import independent, shared_checkpoints


def band_masks(points: int, distance: int, bits: int = 64) -> list[int]:
    """Masks of the bits on which hashes of at most ``distance`` differing bits meet, for so many distinct hashes.

    The bits are cut in m bands; such hashes agree in m - distance of them at least, so each choice of that many bands is a mask,
    and two of them agree on one. More bands are more keys a hash, and more bits a key: m keeps keys and expected chance pairs least.
    """

    def cost(m: int) -> float:
        keys = math.comb(m, m - distance)
        return points * keys + points**2 / 2 * keys / 2.0 ** (bits * (m - distance) // m)

    m = min(range(distance + 1, distance + 6), key=cost)
    cuts = [bits * i // m for i in range(m + 1)]
    bands = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = (sum(c) for c in combinations(bands, m - distance))
    return [x - (1 << bits) if x >> (bits - 1) else x for x in masks]


def hamming_pairs(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """J-06: pairs ``(a, b, distance)`` of ``hashes(id, bits)`` that differ in at most ``distance`` bits.

    Hashes meet on the masks of ``band_masks``, which miss no such pair. Equal hashes meet as one: pairs are made between distinct
    hashes, each named by its first id.
    """
    shared_checkpoints(hashes.sparkSession)
    points = hashes.where("bits is not null").groupBy("bits").agg(F.min("id").alias("id")).checkpoint()
    masks = band_masks(points.count(), distance)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("bits").bitwiseAND(F.lit(x)).alias("value")) for i, x in enumerate(masks))))
    rows = points.select("id", "bits", keys.alias("k")).select("id", "bits", "k.*")
    other = rows.select(F.col("id").alias("other"), F.col("bits").alias("more"), "band", "value")
    pairs = rows.join(other, ["band", "value"]).where((F.col("id") < F.col("other")) & (hamming(F.col("bits"), F.col("more")) <= distance))
    return pairs.select(F.col("id").alias("a"), F.col("other").alias("b"), hamming(F.col("bits"), F.col("more")).cast("long").alias("distance")).distinct()


def leaders(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """T-10: leader of each id, in order of id: the first leader within the distance, or itself."""
    firsts = hashes.groupBy("bits").agg(F.min("id").alias("first"))
    pairs = hamming_pairs(hashes, distance)
    ids = hashes.groupBy("bits").agg(F.min("id").alias("id")).select("id")
    lead = independent(ids, pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = pairs.join(lead.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    named = firsts.join(near, firsts["first"] == near["b"], "left").join(lead.select(F.col("id").alias("lead")), F.col("first") == F.col("lead"), "left")
    return hashes.join(named.select("bits", F.when(F.col("lead").isNotNull(), F.col("first")).otherwise(F.col("leader")).alias("leader")), "bits").select("id", "leader")


def representatives(members: DataFrame) -> DataFrame:
    """W-07: of each cluster, by frame count, two or three evenly spaced members: rows 0, step, 2 step and so on."""
    w = Window.partitionBy("cluster")
    size = F.count("*").over(w)
    rows = members.withColumn("rn", F.row_number().over(w.orderBy(F.desc("frames"), "id")) - 1).withColumn("size", size)
    n = F.least(F.lit(3), F.greatest(F.lit(2), F.col("size")))
    step = F.greatest(F.lit(1), F.floor((F.col("size") - 1) / (n - 1))).cast("int")
    return rows.where((F.col("rn") % step == 0) & (F.col("rn") / step < n)).select("cluster", "id", "rn")


def inherit(annotations: DataFrame, members: DataFrame) -> DataFrame:
    """A-44: annotations for the members ``(id, cluster, representative)`` that have none and stand for no cluster, from the
    annotated representatives of theirs, ``annotations(id, summary, emotion, notes, tags)``.

    Tags: all of them. Emotion: the most frequent (ties: least), or ``unknown``. Notes: the first four distinct ones in order
    of representative and place. Summary: the first two, after a note of where they come from; ``reps`` is how many there are.
    """
    known = members.where("representative and cluster is not null").join(annotations, "id")
    emotion = known.where("emotion <> ''").groupBy("cluster", "emotion").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min_by("emotion", F.struct(-F.col("n"), "emotion")).alias("emotion"))
    tags = known.select("cluster", F.explode("tags").alias("tag")).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    in_order = lambda c, rank: F.transform(F.array_sort(F.collect_list(F.struct(rank, c))), lambda x: x[c])
    notes = known.select("cluster", "id", F.posexplode("notes").alias("pos", "note")).groupBy("cluster", "note").agg(F.min(F.struct("id", "pos")).alias("at"))
    notes = notes.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("at"))).where("r <= 4").groupBy("cluster").agg(in_order("note", "r").alias("notes"))
    summaries = known.where("summary <> ''").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where("r <= 2").groupBy("cluster").agg(F.array_join(in_order("summary", "r"), " | ").alias("said"))
    of_cluster = known.groupBy("cluster").agg(F.count("*").alias("reps"))
    for more in (emotion, tags, notes, summaries):
        of_cluster = of_cluster.join(more, "cluster", "left")
    rows = members.where("not representative").join(annotations.select("id"), "id", "left_anti").join(of_cluster, "cluster")
    said = F.coalesce("said", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return rows.select("id", "cluster", F.coalesce("emotion", F.lit("unknown")).alias("emotion"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.concat(F.lit("[Inherited from cluster "), F.col("cluster").cast("string"), F.lit("] "), said).alias("summary"), "reps")


def meeting(left: DataFrame, right: DataFrame, key: str, other: str, block: int = 1000, tasks: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` where ``key`` equals ``other``; the rows of a key are cut in parts of about ``block`` on either
    side, and each part meets each of the other side, so that a frequent key's pairs are not the work of one task, and no task
    holds more than a part of them. ``tasks``: so many, where the pairs are known to be too many for as few as their rows fill."""
    count = lambda rows, c, n: rows.groupBy(F.col(c).alias("__key")).agg(F.ceil(F.count("*") / block).alias(n))
    often = F.broadcast(count(left, key, "__parts").join(count(right, other, "__others"), "__key").where("__parts > 1 or __others > 1"))
    cut = lambda rows, c: rows.join(often, F.col(c) == F.col("__key"), "left").withColumns({n: F.coalesce(n, F.lit(1).cast("long")) for n in ("__parts", "__others")}).drop("__key")
    one = lambda rows, n: F.pmod(F.xxhash64(*rows.columns), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = cut(left, key).select(*left.columns, one(left, "__parts").alias("__part"), each("__others").alias("__whom"))
    theirs = cut(right, other).select(*right.columns, one(right, "__others").alias("__other"), each("__parts").alias("__who"))
    if tasks:
        mine, theirs = mine.repartition(tasks, key, "__part", "__whom"), theirs.repartition(tasks, other, "__who", "__other")
    met = (F.col(key) == F.col(other)) & (F.col("__part") == F.col("__who")) & (F.col("__whom") == F.col("__other"))
    return mine.join(theirs.hint("merge"), met).select(*left.columns, *right.columns, "__part", "__other")


def by_paths(rows: DataFrame, key: str, path: str) -> DataFrame:
    """``rows`` of each key, all of them and those of its least and its greatest path, for ``elsewhere``."""
    each = rows.groupBy(F.col(key).alias("__key"), F.col(path).alias("path")).agg(F.count("*").alias("n"))
    return each.groupBy("__key").agg(F.sum("n").alias("n"), F.min(F.struct("path", "n")).alias("low"), F.max(F.struct("path", "n")).alias("high"))


def elsewhere(path: str) -> Column:
    """How many rows of ``by_paths`` have another path: exact up to one. More may count those of a path between the ends, too, but
    then there are the ends' beside it."""
    return F.coalesce(F.col("n") - F.when(F.col("low.path") == F.col(path), F.col("low.n")).when(F.col("high.path") == F.col(path), F.col("high.n")).otherwise(0), F.lit(0))


def relinks(catalog: DataFrame, scanned: DataFrame, block: int = 1000) -> DataFrame:
    """J-11 to J-13: proposals for moved files: exact by content, else probable by head and tail; ``conflict`` where a new path has several.

    There is a row for each pair, as many as the product of the two sides of a fingerprint. Whether a row has an exact one and a
    new path several is told from counts by key, before the pairs are made: they are neither shuffled nor sorted.
    """
    shared_checkpoints(catalog.sparkSession)
    known = "path is not null and sha256 is not null"
    s = scanned.where(known).select(F.col("path").alias("new_path"), "sha256", "fingerprint").checkpoint()
    c = catalog.where(known).select("id", F.col("path").alias("old_path"), "sha256", "fingerprint")
    c = c.join(by_paths(s, "sha256", "new_path"), F.col("sha256") == F.col("__key"), "left").withColumn("exact", elsewhere("old_path") > 0)
    c = c.withColumn("moved", F.col("id").isNotNull() & F.max("exact").over(Window.partitionBy("id"))).where("exact or not moved")
    at = lambda kind, key: F.concat(F.lit(kind), key)
    # A row without an exact one has the content of a scanned file at its own path alone, so the rest differ in content.
    mine = c.select("id", "old_path", F.when(F.col("exact"), at("exact", "sha256")).otherwise(at("probable", "fingerprint")).alias("at")).where("at is not null").checkpoint()
    theirs = s.select("new_path", F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), at(kind, key).alias("there")) for kind, key in (("exact", "sha256"), ("probable", "fingerprint"))))))
    theirs = theirs.join(by_paths(mine, "at", "old_path"), F.col("there") == F.col("__key")).withColumn("n", elsewhere("new_path")).where("n > 0")
    several = F.sum("n").over(Window.partitionBy("new_path")) > 1
    theirs = theirs.select("new_path", "there", F.when(several, "conflict").otherwise(F.col("kind")).alias("kind"), "n").checkpoint()
    pairs = theirs.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 10_000_000)
    return meeting(mine, theirs.drop("n"), "at", "there", block, tasks).where("old_path <> new_path").select("id", "old_path", "new_path", "kind")


def ingest(catalog: DataFrame, scanned: DataFrame, distance: int = 5) -> DataFrame:
    """S-04: outcome of each scanned ``(path, sha256, bits)``: registered, or skipped as known, repeated or a near copy."""
    first = scanned.withColumn("n", F.row_number().over(Window.partitionBy("sha256").orderBy("path")))
    rows = first.join(catalog.select("sha256").distinct().withColumn("known", F.lit(True)), "sha256", "left")
    fresh = rows.where("known is null and n = 1")
    hashes = catalog.select(F.concat(F.lit("0"), "sha256").alias("id"), "bits").union(fresh.select(F.concat(F.lit("1"), "path").alias("id"), "bits"))
    pairs = hamming_pairs(hashes, distance)
    bits = hashes.where("bits is not null").groupBy("bits").agg(F.min("id").alias("rep"))
    mine = hashes.where("bits is not null").join(bits, "bits").select("id", "rep")
    lead = independent(bits.select(F.col("rep").alias("id")), pairs.where("substr(b, 1, 1) = '1'").select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = fresh.select(F.concat(F.lit("1"), "path").alias("id"), "path").join(mine, "id", "left").join(lead.select(F.col("id").alias("rep"), F.lit(True).alias("leads")), "rep", "left")
    near = near.select("path", (F.col("rep").isNotNull() & ((F.col("id") != F.col("rep")) | F.col("leads").isNull())).alias("near"))
    return rows.join(near, "path", "left").select("path", F.when(F.col("known").isNotNull(), "known").when(F.col("n") > 1, "repeated").when(F.col("near"), "near copy").otherwise("registered").alias("outcome"))
