"""Embedding near-dedup with randomised-rotation binary codes (operator 4).

Each unit vector is turned by random rotations. Of the first one a code is stored: the signs of its coordinates in bits, with a
correction factor, its inner product with its own code, and its coordinates rounded at random to four bits in bit planes. Bits
of one vector and planes of another give, by counts of bits, an unbiased estimate of their inner product, and the factor a
bound on its error. Only vectors with a pair that the bound can't place below the threshold are fetched and recomputed exactly.
Which pairs meet at all is decided by cells: choices of signs of all rotations, as many tables of them as the recall takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import bound_batches, components, stored
from reelsift.llm.near import Forest, cell_groups, pairs

PLANES = 4  # bits of a rounded coordinate
CODE = "node long, d int, code binary"
CELLS = f"cell long, t int, {CODE}"
#: Factor, lowest coordinate, step of the rounding, and sum of the rounded coordinates.
NUMBERS = 4


def tables_for(n: int, threshold: float, miss: float, per_cell: int = 16) -> tuple[int, int]:
    """Bits of a cell, so that unrelated vectors are about ``per_cell`` to one, and tables, so that a pair at the threshold
    meets in none of them with probability ``miss`` at most."""
    bits = max(3, min(48, ceil(log2(max(n, 2) / per_cell)) if n > per_cell else 3))
    together = (1 - acos(min(1.0, threshold)) / pi) ** bits
    return bits, max(1, ceil(log(miss) / log(1 - together)) if together < 1 else 1)


def rotation(d: int, number: int = 0) -> np.ndarray:
    """A random rotation of d dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([11, number]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; they are scaled first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits (rows of words), bit planes of the rounded coordinates (rows of planes of words) and NUMBERS of turned vectors."""
    n, d = turned.shape
    words = -(-d // 64)
    packed = lambda x: np.packbits(np.pad(x, ((0, 0), (0, 64 * words - d))), axis=1, bitorder="little").view(np.uint64)
    factor = np.abs(turned).sum(1) / np.sqrt(d)
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-12) / (2**PLANES - 1)
    # Rounding at random, the same each time for the same vector.
    dice = np.random.default_rng(17).random((1, d)) + np.random.default_rng(19).random(d)[None, :] * turned * 1e6
    up = np.minimum(np.floor((turned - low[:, None]) / step[:, None] + dice % 1.0), 2**PLANES - 1).astype(np.uint8)
    planes = np.stack([packed(up >> j & 1) for j in range(PLANES)], axis=1)
    return packed(turned > 0), planes, np.stack([factor, low, step, up.sum(1)], axis=1)


def estimates(bits: np.ndarray, planes: np.ndarray, numbers: np.ndarray, d: int, i: np.ndarray, j: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rows i and j by the signs and factor of i and the planes of j, and the bound on their error."""
    own = bits[i]
    shared = sum(np.bitwise_count(own & planes[j, p]).sum(1, dtype=np.int64) << p for p in range(PLANES))
    ones = np.bitwise_count(own).sum(1, dtype=np.int64)
    factor, (_, low, step, total) = numbers[i, 0], numbers[j].T
    raw = (2 * (low * ones + step * shared) - (low * d + step * total)) / np.sqrt(d)
    spread = (1 - np.minimum(factor, 1) ** 2) / max(1, d - 1) + step**2 / 4
    return raw / factor, eps * np.sqrt(spread) / factor


def cells_of(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each vector in each table."""
    d = v.shape[1]
    signs = np.concatenate([v @ rotation(d, k).T > 0 for k in range(-(-tables * bits // d))], axis=1)[:, : tables * bits].reshape(-1, tables, bits)
    value = (signs * (np.uint64(1) << np.arange(bits, dtype=np.uint64))).sum(2, dtype=np.uint64)
    return K.mix(value + (np.arange(tables, dtype=np.uint64) << np.uint64(50)) + (np.uint64(d) << np.uint64(57))).view(np.int64)


def _vectors(column: pa.ListArray | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors, for each length of vectors."""
    size = column.value_lengths().to_numpy()
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, unit(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def _codes(bits: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _vectors(batch.column("embedding")):
                d = v.shape[1]
                sign, planes, numbers = encode(v @ rotation(d).T)
                code = np.concatenate([sign.view(np.uint8).reshape(len(v), -1), planes.reshape(len(v), -1).view(np.uint8), numbers.astype("<f8").view(np.uint8).reshape(len(v), -1)], axis=1)
                code = pa.array([x.tobytes() for x in code], pa.binary())
                node, cell = batch.column("node").take(pa.array(rows)), cells_of(v, bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(cell[:, t]), pa.array([t] * len(rows), pa.int32()), node, pa.array([d] * len(rows), pa.int32()), code], names=["cell", "t", "node", "d", "code"])

    return run


def _decoded(column: pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = -(-d // 64)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    part = lambda a, b, kind: np.ascontiguousarray(raw[:, a:b]).view(kind)
    cut = 8 * words * (1 + PLANES)
    return part(0, 8 * words, np.uint64), part(8 * words, cut, np.uint64).reshape(-1, PLANES, words), part(cut, cut + 8 * NUMBERS, np.float64)


def _near_pairs(table: pa.Table, threshold: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a table sorted by cell whose estimate may lie at the threshold or above."""
    cell, part, cross, length = (table.column(c).to_numpy() for c in ("cell", "part", "cross", "d"))
    for d in np.unique(length):
        own = np.flatnonzero(length == d)
        code = _decoded(table.column("code").take(pa.array(own)), int(d))
        for i, j in pairs(cell[own], part[own], cross[own], 50_000):
            about, error = estimates(*code, int(d), i, j, eps)
            near = about + error >= threshold
            yield own[i[near]], own[j[near]]


def _undecided(threshold: float, eps: float) -> Callable[[pa.Table], pa.Table]:
    """The rows of a group that have a pair to recompute."""

    def run(table: pa.Table) -> pa.Table:
        table, wanted = table.sort_by("cell").combine_chunks(), np.zeros(table.num_rows, bool)
        for i, j in _near_pairs(table, threshold, eps):
            wanted[i] = wanted[j] = True
        out = table.filter(pa.array(wanted))
        K.tidy()
        return out

    return run


def _links(threshold: float, eps: float, bits: int, tables: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell").combine_chunks()
        node, size, t = (table.column(c).to_numpy() for c in ("node", "size", "t"))
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        where, known = np.zeros(len(node), np.int64), {}
        for rows, v in _vectors(table.column("embedding").combine_chunks()):
            where[rows] = np.arange(len(rows))
            known[v.shape[1]] = v, cells_of(v, bits, tables)
        length = table.column("d").to_numpy()
        for i, j in _near_pairs(table, threshold, eps):
            if not len(i):
                continue
            v, cells = known[length[i[0]]]
            a, b = where[i], where[j]
            exact = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
            i, j, a, b = i[exact], j[exact], a[exact], b[exact]
            forest.link(i, j)
            # A pair that shares cells of several tables counts in the first of them.
            met = (cells[a] == cells[b]).argmax(1) == t[i]
            np.add.at(links, i[met], size[j[met]])
            np.add.at(links, j[met], size[i[met]])
        i, j = forest.edges()
        some = np.flatnonzero(links)
        none = np.zeros(len(i), np.int64)
        K.tidy()
        return pa.table({"a": np.concatenate([node[i], node[some]]), "b": np.concatenate([node[j], node[some]]), "n": np.concatenate([none, links[some]])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, miss: float = 0.005, eps: float = 4.0, block: int = 2048) -> DataFrame:
    """Link vectors with cosine of at least ``threshold``, in double precision.

    Returns per row vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept
    (vec_id = component_id). Links that are given are exact; a pair at the threshold is missed with probability ``miss``,
    a closer one less. ``eps`` is the width of the error bound in standard deviations of the estimate.

    Equal vectors are one point with a count, and link with each other. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Vectors of different lengths don't link. A null vec_id keeps its row and
    counts as a link of others, but names no component unless it is alone. Repeated rows are vectors each. An empty table
    gives an empty result; other columns are ignored.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(fine, F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))), 256)))
    points = stored(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding")).where("node is not null"), "vectors")
    n = points.count()
    bits, tables = tables_for(n, threshold, miss)
    codes = stored(points.select("node", "embedding").mapInArrow(K.tidied(_codes(bits, tables)), CELLS), "codes")
    groups = cell_groups(codes, "node", n * tables, block, group=20_000, sparse=False)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    open_ = groups.groupBy("g").applyInArrow(_undecided(threshold, eps), kind)
    found = open_.join(points.select("node", "size", "embedding"), "node").groupBy("g").applyInArrow(_links(threshold, eps, bits, tables), "a long, b long, n long")
    found = stored(found, "links")
    names = components(found.where("a <> b").select("a", "b"))
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = points.select("key", "node", "size").join(links, "node", "left").join(names, "node", "left").select("key", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
