"""Joins within cells, for points that are compared only where they share a cell."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import partitions, stored


#: Large cells that may be broadcast.
BROADCAST_CELLS = 500_000


def cell_groups(rows: DataFrame, node: str, total: int, block: int = 2048, group: int = 50_000, weight: Column | None = None, settled: Column | None = None, sparse: bool = True) -> DataFrame:
    """Rows ``(cell long, node, ...)`` with ``g``, the group to compare in, ``part`` and ``cross``.

    A row weighs 1, or ``weight``. Cells of one row are left out. Cells of a weight up to ``block`` share groups, as many as keep a
    group of the ``total`` weight at about ``group`` at most. Larger cells are cut in parts, and each pair of parts makes a group,
    so that no task holds more than two parts; ``cross`` then asks for pairs of different parts. Rows that are ``settled`` need no
    comparing with each other: in a large cell they meet the parts of the other rows only. ``sparse``: most cells have one row, so
    that it pays to look for the others first; else only the large cells are looked for, and rows of the others move once.
    """
    weight = F.lit(1) if weight is None else weight
    open_ = F.lit(True) if settled is None else ~settled
    kept = rows.withColumns({"weight_": weight.cast("long"), "open_": open_})
    sizes = kept.groupBy("cell").agg(F.count("*").alias("n_"), F.sum("weight_").alias("w_"), F.coalesce(F.sum(F.when(F.col("open_"), F.col("weight_"))), F.lit(0)).alias("u_")).where("n_ > 1")
    if not sparse:
        sizes = stored(sizes.where(F.col("w_") > block), "large")
    # A row of sizes is 40 bytes, and of large cells there are total / block at most.
    small_sizes = not sparse and sizes.count() <= BROADCAST_CELLS
    kept = kept.join(F.broadcast(sizes) if small_sizes else sizes, "cell", "inner" if sparse else "left")
    groups = F.lit(max(4 * partitions(rows.sparkSession), ceil(total / group))).cast("long")
    small = kept.where(F.coalesce(F.col("w_"), F.lit(0)) <= block).select(F.pmod(F.xxhash64("cell"), groups).alias("g"), *rows.columns, F.lit(0).cast("long").alias("part"), F.lit(False).alias("cross"))
    # Parts of the open rows come first, then those of the settled ones.
    first, rest = F.ceil(F.col("u_") / block), F.ceil((F.col("w_") - F.col("u_")) / block)
    large = kept.where(F.col("w_") > block).withColumn("part", F.when(F.col("open_"), F.pmod(F.xxhash64(node, "cell"), first)).otherwise(first + F.pmod(F.xxhash64(node, "cell"), rest)))
    meets = F.when(F.col("open_"), first + rest).otherwise(first)
    large = large.withColumn("other", F.explode(F.when(meets > 0, F.sequence(F.lit(0).cast("long"), meets - 1))))
    # The part with itself needs its rows once; a pair of parts gets the rows of both.
    large = large.withColumn("g", F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    large = large.select("g", *[F.col("g").alias("cell") if c == "cell" else F.col(c) for c in rows.columns], "part", (F.col("part") != F.col("other")).alias("cross"))
    return small.union(large)


def pairs(cell: np.ndarray, part: np.ndarray, cross: np.ndarray, at_least: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows in the same cell, in bounded arrays; rows are sorted by cell."""
    left, right, size = [], [], 0
    i = np.arange(len(cell) - 1)
    d = 1
    while len(i):
        i = i[i + d < len(cell)]
        i = i[cell[i] == cell[i + d]]
        ok = i[~cross[i] | (part[i] != part[i + d])]
        left.append(ok), right.append(ok + d)
        size += len(ok)
        if size >= at_least:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
        d += 1
    if size:
        yield np.concatenate(left), np.concatenate(right)


class Forest:
    """Connected rows of a group; of all links between them only a spanning forest leaves the task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]
