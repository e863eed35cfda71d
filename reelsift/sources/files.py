"""Files as tables: media scans, imports, exports and idempotent appends."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import clip_interval, scenario_keys
from reelsift.operators.digest import digests

#: Extensions of media files.
IMAGES, VIDEOS = [".jpg", ".jpeg", ".png", ".webp"], [".mp4", ".mkv", ".avi", ".mov", ".webm"]


#: Stores whose files tasks read in ranges. What lies elsewhere comes whole through Spark's reader, which stops at 2 GB.
RANGED = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _opened(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(inner)


def _digested(block: int, step: int = 8 << 20):
    """sha256 of each file, fed block by block, and of its first and last ``block`` bytes, read by seeks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ends = [], []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with _opened(path) as f:
                    edge = hashlib.sha256(f.read_at(min(block, length), 0))
                    if length > block:
                        edge.update(f.read_at(block, length - block))
                    digest = hashlib.sha256()
                    for at in range(0, length, step):
                        digest.update(f.read_at(min(step, length - at), at))
                whole.append(digest.hexdigest()), ends.append(edge.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.string()), pa.array(ends, pa.string())], names=[*batch.schema.names, "sha256", "ends"])

    return run


def scan_media(spark: SparkSession, root: str, block: int = 1 << 20, include_mtime: bool = False) -> DataFrame:
    """S-01 to S-03: media files below a folder: path, media_type, length, sha256 and head/tail fingerprint.

    The listing reads no contents; tasks then read their files in ranges, so that one of any length takes bounded memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(ext.isin(IMAGES), "image").when(ext == ".gif", "gif").when(ext.isin(VIDEOS), "video")
    listed = files.withColumn("media_type", kind).where("media_type is not null")
    scheme = re.match(r"([a-z0-9]+):", root)
    if not scheme or scheme[1] in RANGED:
        rows = listed.select("path", "media_type", "length", "modificationTime")
        rows = rows.mapInArrow(_digested(block), "path string, media_type string, length long, modificationTime timestamp, sha256 string, ends string")
    else:
        head = F.substring("content", 1, block)
        both = F.when(F.col("length") > block, F.concat(head, F.expr(f"substring(content, -{block})"))).otherwise(head)
        rows = listed.select("path", "media_type", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), F.sha2(both, 256).alias("ends"))
    parts = [F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string") if include_mtime else F.lit(""), F.col("ends")]
    return rows.select("path", "media_type", "length", "sha256", F.concat_ws(":", *parts).alias("fingerprint"))


def folder_candidates(files: DataFrame, known: DataFrame) -> DataFrame:
    """S-05: exported clips that aren't known yet, with id, interval and source name from their names."""
    new = files.where(F.lower("path").endswith(".gif")).join(known.select("path"), "path", "left_anti")
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.try_element_at(F.split("path", "/"), F.lit(-2))
    source = F.when(F.contains(name, F.lit("@@@")), F.split(name, "@@@")[0]).otherwise(parent)
    return new.select(F.concat(F.lit("cand_fs_"), F.sha2("path", 256)).alias("id"), "path", source.alias("source"), clip_interval(name).alias("i")).select("id", "path", "source", "i.start", "i.end")


def run_candidates(results: DataFrame) -> DataFrame:
    """S-06: clips of pipeline results ``(video, sha256, top_clips)`` as candidates in order."""
    rows = results.select("video", "sha256", F.posexplode("top_clips").alias("pos", "c"))
    return rows.select(F.format_string("adaptive-clip-%04d", F.col("pos") + 1).alias("run_candidate_id"), "video", F.coalesce("sha256", F.sha2("video", 256)).alias("sha256"), "c.*")


def candidate_id(video, start, end, run_id):
    """S-07: an id of video, times and the run's own id; a null part is empty."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (video, start, end, run_id)]
    return F.concat(F.lit("cand_"), F.sha2(F.concat(*parts), 256))


def materialize(results: DataFrame, existing: DataFrame) -> DataFrame:
    """S-07: new candidates of runs ``(run_id, run_candidate_id, sha256, start, end, emotion, scene, tags, ...)``: those whose id is
    not in ``existing``, with scenario keys and the status ``candidate``. Of rows of one id the first run's is taken."""
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    rows = results.withColumn("candidate_id", candidate_id(F.col("sha256"), start, end, F.col("run_candidate_id")))
    rows = rows.withColumns({"scenario_keys": scenario_keys(F.col("emotion"), F.col("scene"), F.col("tags")), "status": F.lit("candidate")})
    rest = [c for c in rows.columns if c != "candidate_id"]
    one = rows.groupBy("candidate_id").agg(F.min_by(F.struct(*rest), F.struct("run_id", "run_candidate_id")).alias("x")).select("candidate_id", "x.*")
    return one.join(existing.select("candidate_id"), "candidate_id", "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Z-07: rows to append, and rows whose id exists with other fields. The same row again is neither."""
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    known = existing.select(key, digest.alias("have"))
    rows = incoming.withColumn("want", digest).withColumn("n", F.row_number().over(Window.partitionBy(key, "want").orderBy(*fields))).where("n = 1").drop("n")
    rows = rows.join(known, key, "left").withColumn("first", F.min("want").over(Window.partitionBy(key)))
    new = rows.where("have is null and want = first").select(incoming.columns)
    return new, rows.where("(have is not null and have <> want) or (have is null and want <> first)").select(incoming.columns)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """S-08: a JSONL file of judgments, the last of each candidate; blank lines are passed over, a broken line fails the read."""
    rows = spark.read.schema("candidate_id string, rating string, judged_at string").option("mode", "FAILFAST").json(path)
    return last_judgments(rows.where("candidate_id is not null"))


def last_judgments(rows: DataFrame) -> DataFrame:
    """S-08: the last judgment of each candidate, by time and rating."""
    return rows.groupBy("candidate_id").agg(F.max_by("rating", F.struct("judged_at", "rating")).alias("rating"))


#: The columns of an item beside its id and tags.
ITEM_FIELDS = ["source_path", "video_fingerprint", "duration_bucket", "resolution_bucket", "pace_bucket"]


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """S-10: items of a CSV with a header; columns that it lacks are null."""
    return benchmark_items(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def benchmark_items(rows: DataFrame) -> DataFrame:
    """S-10: items: every field trimmed, tags split by bar, id from the file's stem."""
    field = lambda c: (F.trim(c) if c in rows.columns else F.lit(None).cast("string")).alias(c)
    out = rows.select(*map(field, ITEM_FIELDS), F.split(F.coalesce("difficulty_tags", F.lit("")), r"\|").alias("tags"))
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return out.select(stem.alias("item_id"), *ITEM_FIELDS, F.filter(F.transform("tags", lambda x: F.trim(x)), lambda x: x != "").alias("difficulty_tags"))


def freeze(items: DataFrame, version: int = 1) -> DataFrame:
    """S-15: one digest of the items' ``(fingerprint, item)`` and the version, whatever their order, their number, and how many
    repeat a fingerprint."""
    seen = items.groupBy("fingerprint").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    row = digests(items, ["fingerprint", "item"]).crossJoin(F.broadcast(seen))
    return row.select(F.sha2(F.concat(F.lit(f"{version}|"), F.col("digest")), 256).alias("manifest_id"), F.col("n").alias("items"), "repeated")


def write_manifest(items: DataFrame, path: str, version: int = 1) -> str:
    """S-15: write items ``(fingerprint, item)`` of distinct fingerprints with their manifest, and return its id. A manifest that is
    there already is not written over."""
    row = freeze(items, version).first()
    if row.repeated:
        raise ValueError(f"{row.repeated} items repeat a fingerprint")
    items.select("fingerprint", "item").write.mode("errorifexists").parquet(f"{path}/items")
    items.sparkSession.createDataFrame([(row.manifest_id, version, row["items"])], "manifest_id string, version int, items long").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return row.manifest_id


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S-15: the items of a written manifest; fails where they are not those that it was written with, or repeat a fingerprint."""
    kept = spark.read.schema("manifest_id string, version int, items long").json(f"{path}/manifest").first()
    items = spark.read.parquet(f"{path}/items")
    row = freeze(items, kept.version).first()
    if row.manifest_id != kept.manifest_id or row.repeated:
        raise ValueError(f"the items are not those of manifest {kept.manifest_id}")
    return items


def collection_manifest(items: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-13: of the latest version of each collection ``(collection, version, rank, id)``: the items that have a candidate, ranked anew
    from 0, those that have none, and the manifest, a row of counts for each collection."""
    newest = items.groupBy("collection").agg(F.max("version").alias("version"))
    latest = items.join(newest, ["collection", "version"])
    known = candidates.select("id", *(c for c in candidates.columns if c not in items.columns))
    rank = (F.row_number().over(Window.partitionBy("collection").orderBy("rank", "id")) - 1).cast("long")
    rows = latest.join(known, "id").withColumn("rank", rank)
    missing = latest.join(candidates.select("id"), "id", "left_anti").select("collection", "version", "id")
    marked = latest.join(candidates.select("id").distinct().withColumn("there", F.lit(1)), "id", "left")
    manifest = marked.groupBy("collection", "version").agg(F.count("there").alias("exported"), F.count_if(F.col("there").isNull()).alias("missing"))
    return rows, missing, manifest


def named_manifests(manifest: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-13: the manifest of ``collection_manifest`` with the name and search, a JSON text, of its collections ``(collection, name,
    search)``; and the collections that have no version to export. One that is not known is left out of the manifest."""
    known = collections.select("collection", "name", F.coalesce("search", F.lit("{}")).alias("search"))
    rows = manifest.join(known, "collection").select("collection", "name", "version", "search", "exported", "missing")
    return rows, collections.join(manifest.select("collection"), "collection", "left_anti").select("collection", "name")


def export_collections(items: DataFrame, candidates: DataFrame, path: str, collections: DataFrame | None = None) -> DataFrame:
    """S-13: write items, missing ids and manifest as JSON below the path, by collection and version, and return the manifest, with
    names and searches where ``collections`` gives them. What is there of other collections and versions stays."""
    parts = dict(zip(("items", "missing", "manifest"), collection_manifest(items, candidates)))
    if collections is not None:
        parts["manifest"] = named_manifests(parts["manifest"], collections)[0]
        parts = {n: x.join(collections.select("collection"), "collection", "left_semi") for n, x in parts.items()}
    for name, rows in parts.items():
        keep = [c for c in rows.columns if c not in ("collection", "version")]
        if name == "items":
            rows = rows.repartitionByRange("collection", "rank").sortWithinPartitions("collection", "version", "rank")
        rows.select("collection", "version", *keep).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "version").json(f"{path}/{name}")
    return parts["manifest"]


def append(rows: DataFrame, path: str) -> None:
    """S-18: the sink of events: append to a Parquet table."""
    rows.write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> int:
    """Replace the table at ``path`` by ``rows``, which may read the table itself; returns the number of the snapshot.

    Rows go to a folder of their own and count once its commit is written, so a run that breaks off leaves the last snapshot
    whole. Folders without a commit are left over from such runs.
    """
    spark = rows.sparkSession
    number = max([r.snapshot for r in _commits(spark, path).collect()], default=0) + 1
    folder = f"{number}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{folder}")
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/snapshot={number}")
    return number


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("folder string, snapshot long").parquet(f"{path}/commits")
    except AnalysisException:  # nothing has been committed yet
        return spark.createDataFrame([], "folder string, snapshot long")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as of the last commit."""
    last = _commits(spark, path).agg(F.max_by("folder", "snapshot")).first()[0]
    if last is None:
        raise ValueError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/data/{last}")
