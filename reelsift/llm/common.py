"""Storage, graph and sizing helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there and lost executors cost no recomputation before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that no later step reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished steps now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound what reaches Python at once by bytes: texts differ in length by orders of magnitude, so a count of rows bounds nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one pass that shuffles nothing but sums."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def components(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(node, component)``, component the smallest node.

    Alternates large-star and small-star steps; each is a grouped minimum and a join on the node, so neither a node's
    neighbours nor a component are gathered in one place. Ends when a round leaves the edges as they were. Null ends and
    loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
        .checkpoint()
    )
    seen = None
    while True:
        # Large star: each neighbour above a node goes to the node's smallest neighbour or itself.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: each neighbour below a node, and the node, go to the smallest of them.
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(root, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(root.select("hi", F.col("m").alias("lo")))
            .where("hi <> lo").distinct()
        )
        now = small.checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
