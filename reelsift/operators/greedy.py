"""Sequential greedy choices, computed in rounds over a graph."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> None:
    """Have checkpoints go to spark.checkpoint.dir; where it is unset, to a folder of our own, in local mode alone."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, for tables that a job writes and reads again."""
    shared_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of ``nodes(id)`` that a pass in order of priority keeps: each is kept unless a kept one comes before it on an edge.

    ``edges(id, other)`` point to the neighbours of higher priority. In each round, nodes with no undecided neighbour before
    them are kept and drop those behind them; rounds end when all are decided. A round writes what is still undecided and
    what it has kept, no earlier choice again.
    """
    shared_checkpoints(nodes.sparkSession)
    edges = edges.distinct().checkpoint()
    left = edges.select("id").distinct().checkpoint()
    first = nodes.select("id").distinct().join(left, "id", "left_anti").checkpoint()
    kept = first
    while not left.isEmpty():
        gone = edges.join(first.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        done = first.union(gone).checkpoint()
        edges = edges.join(done, "id", "left_anti").join(done.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other").checkpoint()
        left = left.join(done, "id", "left_anti").checkpoint()
        first = left.join(edges.select("id").distinct(), "id", "left_anti").checkpoint()
        kept = kept.union(first)
    return kept
