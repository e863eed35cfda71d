"""Why a candidate ranks where it does or was selected, what a frame's neighbours say, and a map of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.functions.columns import dot
from reelsift.operators.vectors import neighbours


def ranking_explanation(ranked: DataFrame, positives: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """H-06: rows of ``rerank``, a stated set of them, with zeros for missing parts and the nearest of the positives."""
    queries = vectors.join(ranked.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "vector")
    near = neighbours(queries, vectors.join(positives.select("id"), "id", "left_semi"), k)
    ids = near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id.cast("string")), ",").alias("nearest"))
    part = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ranked.join(ids, ranked.id == ids.query_id, "left").select("id", "base", part("global_like"), part("scenario_like"), part("dislike"), "final_score", F.coalesce("nearest", F.lit("")).alias("nearest"))


def selection_explanation(rows: DataFrame, components: list[str], origin: list[str]) -> DataFrame:
    """H-07: the stored components that aren't null as a map, and a sentence with them and where the candidate comes from."""
    stored = F.map_filter(F.create_map(*(x for c in components for x in (F.lit(c), F.col(c).cast("double")))), lambda _, v: v.isNotNull())
    parts = F.concat_ws("; ", *(F.when(F.col(c).isNotNull(), F.format_string(f"{c}=%.2f", F.col(c).cast("double"))) for c in components))
    where = F.concat_ws(", ", *(F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in origin))
    return rows.select("id", stored.alias("components"), F.concat(F.lit("Selected with "), parts, F.lit(" ("), where, F.lit(")")).alias("sentence"))


def retrieval_context(queries: DataFrame, index: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """H-08: the k nearest of the index for each query, in order, with emotion and the first three tags."""
    near = neighbours(queries, index, k).join(labels, "id", "left")
    one = F.struct("rank", "id", "similarity", "emotion", F.slice("tags", 1, 3).alias("tags"))
    return near.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("context"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key of a batch: number, sum and products of its vectors."""
    for batch in batches:
        keys, vectors = batch.column("key"), batch.column("vector")
        coded = keys.dictionary_encode() if not pa.types.is_dictionary(keys.type) else keys
        number = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
        rows = np.array(vectors.to_pylist(), float) if batch.num_rows else np.zeros((0, 0))
        for k in np.unique(number):
            x = rows[number == k]
            sums = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([keys.slice(int(np.argmax(number == k)), 1), pa.array([sums], pa.list_(pa.float64()))], names=["key", "sums"])


def _axes(frame: pd.DataFrame) -> pd.DataFrame:
    sums = np.sum(np.stack(frame["sums"].to_list()), axis=0)
    n = sums[0]
    d = round((math.sqrt(1 + 4 * (len(sums) - 1)) - 1) / 2)
    mean = sums[1 : d + 1] / n
    spread = sums[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    value, vector = np.linalg.eigh(spread)
    order = np.argsort(-value)[:2]
    axes = [vector[:, i] if value[i] > 1e-12 * max(1.0, np.trace(np.outer(mean, mean))) else np.zeros(d) for i in order] + [np.zeros(d)] * (2 - len(order))
    return pd.DataFrame({"key": [frame["key"].iloc[0]], "mean": [mean.tolist()], "a": [axes[0].tolist()], "b": [axes[1].tolist()]})


def taste_maps(vectors: DataFrame, key: str) -> DataFrame:
    """H-10: coordinates ``(x, y)`` of ``vectors(id, vector)`` on the first two principal axes of their ``key``, a collection say.

    Vectors of a key are of one length. Tasks give sums of products, d * d cells for a key however many rows it has, and a
    key's axes come from their sum. The point farthest out on an axis lies on its positive side (of equal ones that of the
    least id). A single vector lies at (0, 0), and so does an axis along which nothing differs; rows without a vector are left out.
    """
    rows = vectors.where("vector is not null").select(F.col(key).alias("key"), "id", F.col("vector").cast("array<double>").alias("vector"))
    kind = rows.schema["key"].dataType.simpleString()
    moments = rows.select("key", "vector").mapInArrow(_moments, f"key {kind}, sums array<double>")
    # Partial sums of a task's batches meet by position before the shuffle.
    parts = moments.select("key", F.posexplode("sums").alias("p", "x")).groupBy("key", "p").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda c: c.x).alias("sums"))
    axes = whole.groupBy("key").applyInPandas(_axes, f"key {kind}, mean array<double>, a array<double>, b array<double>").withColumnRenamed("key", "__key")
    on = lambda axis: dot(F.zip_with("vector", "mean", lambda v, m: v - m), F.col(axis))
    at = rows.join(axes, F.col("key").eqNullSafe(F.col("__key"))).select("key", "id", on("a").alias("x"), on("b").alias("y"))
    side = lambda c: F.when(F.max_by(c, F.struct(F.round(F.abs(c), 9), -F.col("id"))) < 0, -1.0).otherwise(1.0)
    sides = at.groupBy(F.col("key").alias("__key")).agg(side(F.col("x")).alias("sx"), side(F.col("y")).alias("sy"))
    return at.join(sides, F.col("key").eqNullSafe(F.col("__key"))).select(F.col("key").alias(key), "id", (F.col("x") * F.col("sx")).alias("x"), (F.col("y") * F.col("sy")).alias("y"))


def taste_map(vectors: DataFrame) -> DataFrame:
    """H-10: one map of all vectors, by ``taste_maps``."""
    return taste_maps(vectors.withColumn("__all", F.lit(0)), "__all").select("id", "x", "y")
