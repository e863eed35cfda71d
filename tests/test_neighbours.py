"""Nearest neighbours in blocks against a plain join."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelsift.functions import columns
from reelsift.operators import vectors


def plain(queries, index, k):
    rows = queries.crossJoin(index.withColumnRenamed("vector", "other")).where("query_id <> id")
    rows = rows.select("query_id", "id", F.round(columns.dot(columns.unit(F.col("vector")), columns.unit(F.col("other"))), 6).alias("similarity"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    return sorted(map(repr, rows.select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank")).collect()))


def test_neighbours_of_copies_and_odd_vectors_are_those_of_a_plain_join(spark):
    r = random.Random(3)
    some = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    rows = [(i, some[i % 30] if i % 3 else [x + r.uniform(-2e-7, 2e-7) for x in some[i % 30]]) for i in range(150)]
    rows += [(150, None), (151, [0.0] * 4), (152, [1.0, None, 0.0, 0.0]), (153, [1.0, 2.0]), (154, []), (155, [math.nan, 0.0, 0.0, 1.0]), (156, [1e-200] * 4), (None, some[0])]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    queries = index.where("id % 7 = 0 or id >= 150").withColumnRenamed("id", "query_id")
    for k, blocks, at_once in ((10, None, 8192), (3, 2, 5), (60, 1, 8192), (170, 4, 9)):
        got = vectors.neighbours(queries, index, k, blocks, at_once)
        assert sorted(map(repr, got.collect())) == plain(queries, index, k)
    assert vectors.neighbours(queries, index.limit(0), 3).count() == vectors.neighbours(queries.limit(0), index, 3).count() == 0
    # Rounded halves.
    halves = [0.0000005, -0.0000005, 0.1234565, 0.1234575, -0.1234565, 1.0000005, 0.9999995, 1e-9, -1e-9, 0.5]
    want = [x.y for x in spark.createDataFrame([(x,) for x in halves], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert list(map(repr, map(float, vectors._half_up(vectors.np.array(halves))))) == list(map(repr, want))


def test_a_block_of_neighbours_is_one_product(spark):
    """Comparing by lambdas, a pair took a microsecond for each of its positions or so."""
    import time

    import numpy as np
    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 64).cast(pa.list_(pa.float64()))
    began = time.process_time()
    got = vectors._nearest(10)(pa.table({"query_id": np.arange(200), "qv": lists(x[:200])}), pa.table({"id": np.arange(20_000), "iv": lists(x)}))
    assert got.num_rows == 2000 and time.process_time() - began < 20
    near = x[:200] @ x.T
    near[np.arange(200), np.arange(200)] = -1
    assert got.column("similarity").to_pylist() == pytest.approx(np.sort(near, axis=1)[:, :-11:-1].ravel().tolist(), abs=1e-6)
