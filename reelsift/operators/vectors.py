"""Vectors: means, similarity, neighbours, health."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsift.functions.columns import dot, unit


def weighted_mean(rows: DataFrame, keys: list[str], vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """A-19, A-45: weighted mean vector of each group; none where the weights don't sum to more than 0.

    Sums are by position, so a group of any size combines before the shuffle.
    """
    w = F.lit(1.0) if weight is None else weight
    each = rows.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__p", "__v"))
    sums = each.groupBy(*keys, "__p").agg(F.sum("__w").alias("__w"), F.sum(F.col("__w") * F.col("__v").cast("double")).alias("__s")).where("__w > 0")
    cells = F.array_sort(F.collect_list(F.struct("__p", (F.col("__s") / F.col("__w")).alias("v"))))
    return sums.groupBy(*keys).agg(F.transform(cells, lambda x: x.v).alias("mean"))


def media_vectors(media: DataFrame, texts: DataFrame, frames: DataFrame) -> DataFrame:
    """A-45: a vector ``(id, vector, origin)`` of each of ``media(id)``: that of its text, ``texts(id, vector)``, else the mean of its
    frames', ``frames(id, vector)``, else null."""
    mean = weighted_mean(frames.where("vector is not null"), ["id"])
    rows = media.select("id").join(texts.select("id", F.col("vector").cast("array<double>").alias("said")), "id", "left").join(mean, "id", "left")
    return rows.select("id", F.coalesce("said", "mean").alias("vector"), F.when(F.col("said").isNotNull(), "text").when(F.col("mean").isNotNull(), "frames").alias("origin"))


def diversity(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """A-40: mean pairwise cosine distance in closed form; zero vectors are at distance 1, and fewer than two give 0."""
    u = rows.select(*keys, unit(F.col(vector)).alias("u"))
    n = u.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(dot(F.col("u"), F.col("u"))).alias("own"))
    total = u.select(*keys, F.posexplode("u").alias("p", "x")).groupBy(*keys, "p").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    return n.join(total, keys).select(*keys, "n", F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))), 6).alias("diversity"))


def _half_up(x: np.ndarray) -> np.ndarray:
    """Spark's ``round(x, 6)``: halves of the shortest decimal form go away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e6 + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length of vectors (-1 for none): their row numbers and the vectors as a matrix."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), np.maximum(size, 0)
    start, lengths = np.cumsum(width) - width, np.unique(size)
    return {int(n): (at, flat[start[at][:, None] + np.arange(max(n, 0))]) for n in lengths for at in (np.flatnonzero(size == n),)}


def _nearest(k: int):
    """The k best of a block of the index for each query of a block, by rounded similarity and id."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        query, ids = queries.column("query_id").to_numpy(), index.column("id").to_numpy()
        of_length, out = _by_length(index.column("iv")), []
        for n, (rows, matrix) in _by_length(queries.column("qv")).items():
            at, vectors = of_length.get(n, (np.zeros(0, np.int64), np.zeros((0, 0)))) if n >= 0 else (np.zeros(0, np.int64), None)
            rest = np.sort(np.delete(ids, at))
            for i in range(0, len(rows), 64):
                some = rows[i : i + 64]
                near = matrix[i : i + 64] @ vectors.T if len(at) else np.zeros((len(some), 0))
                near[np.isnan(near)] = np.inf
                near[query[some][:, None] == ids[at]] = -np.inf
                # Within 3e-6 of the k-th best one may be level with it when rounded; these are summed again in Spark's order.
                least = np.partition(near, -k, axis=1)[:, -k] - 3e-6 if len(at) > k else np.full(len(some), -np.inf)
                for r, row in enumerate(some):
                    hit = np.flatnonzero((near[r] >= least[r]) & (near[r] > -np.inf))
                    sums = np.zeros(len(hit))
                    for x, y in zip(matrix[i + r], vectors[hit].T if len(hit) else ()):
                        sums += x * y
                    value, of = _half_up(sums), ids[at[hit]]
                    best = np.lexsort((of, np.where(np.isnan(value), -np.inf, -value)))[:k]
                    # Without a vector, or with one of another length, there is no similarity: such come last.
                    last = rest[rest != query[row]][: k - len(best)] if len(best) < k else rest[:0]
                    out.append((np.full(len(best) + len(last), query[row]), np.append(of[best], last), np.append(value[best], np.zeros(len(last))), np.append(np.zeros(len(best), bool), np.ones(len(last), bool))))
        cells = [np.concatenate(x) for x in zip(*out)] if out else [query[:0], ids[:0], np.zeros(0), np.zeros(0, bool)]
        return pa.table({"query_id": cells[0], "id": cells[1], "similarity": pa.array(cells[2], mask=cells[3], from_pandas=False)})

    return run


def neighbours(queries: DataFrame, index: DataFrame, k: int, blocks: int | None = None, at_once: int = 8192) -> DataFrame:
    """J-08, T-07: the k nearest of ``index(id, vector)`` by cosine for each of ``queries(query_id, vector)``, itself excluded.

    A stated query set against all rows in blocks: the index is dealt out in blocks, the queries, ``at_once`` of them, go to each,
    and each block keeps its own best k per query before the last ranking. There are 16 blocks at least, and one for each 32,768
    rows. A block's similarities are a product of matrices; those that may be among the best are summed in double precision in
    order of the positions, so that they are those of ``dot``.
    """
    blocks, parts = blocks or max(16, ceil(index.count() / 32_768)), max(1, ceil(queries.count() / at_once))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("long"))
    i = index.where("id is not null").select("id", unit(F.col("vector")).alias("iv"), mine("id", blocks).alias("b")).select("*", every(parts).alias("p"))
    q = queries.where("query_id is not null").select("query_id", unit(F.col("vector")).alias("qv"), mine("query_id", parts).alias("p")).select("*", every(blocks).alias("b"))
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {i.schema['id'].dataType.simpleString()}, similarity double"
    best = q.groupBy("b", "p").cogroup(i.groupBy("b", "p")).applyInArrow(_nearest(k), kinds)
    order = (F.desc("similarity"), F.col("id"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


def health(candidates: DataFrame, vectors: DataFrame, excluded: DataFrame, dim: int) -> DataFrame:
    """A-12, A-13: candidates, those with a vector of the dimension, those excluded and those missing."""
    have = vectors.where(F.size("vector") == dim).select("id").distinct()
    marked = candidates.select("id").distinct().join(have.withColumn("have", F.lit(1)), "id", "left").join(excluded.select("id").distinct().withColumn("out", F.lit(1)), "id", "left")
    return marked.agg(F.count("*").alias("total"), F.count("have").alias("available"), F.count("out").alias("excluded"), F.count_if(F.col("have").isNull() & F.col("out").isNull()).alias("missing"))


def index_health(candidates: DataFrame, indexed: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """A-13: one row: candidates, indexed ones, those with a vector of the model and dimension, those without, whether the index
    is complete, and what is missing. No candidates are a complete library."""
    total = candidates.agg(F.count("*").alias("total"))
    listed = indexed.agg(F.count("*").alias("indexed"))
    available = vectors.where((F.col("model") == model) & (F.col("dim") == dim)).agg(F.count_distinct("id").alias("available"))
    row = total.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(available))
    n, short = F.col("total"), lambda c, words: F.when(F.col(c) < F.col("total"), F.concat(F.lit(words), F.col(c).cast("string"), F.lit(" of "), F.col("total").cast("string")))
    complete = (n == 0) | ((F.col("indexed") >= n) & (F.col("available") >= n))
    diagnosis = F.when(complete, "complete").otherwise(F.concat_ws("; ", short("indexed", "indexed "), short("available", "with vectors ")))
    return row.select("total", "indexed", "available", (n - F.col("available")).alias("missing"), complete.alias("complete"), diagnosis.alias("diagnosis"))
