"""SimHash near-dedup by segment popcounts (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import components, stored
from reelsift.llm.near import Forest, cell_groups, pairs

_LOWER = K.LOWER.tobytes()
SEGMENTS = 32  # of two bits each


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of each whole text."""

    def bits(hashes: np.ndarray, n: list[int]) -> np.ndarray:
        to = np.append(0, np.cumsum(n))
        ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out = np.zeros((len(n), 64), np.uint8)
        some = np.flatnonzero(np.diff(to))
        if len(some):
            out[some] = 2 * np.add.reduceat(ones, to[some], axis=0, dtype=np.int64) > np.diff(to)[some, None]
        return np.packbits(out, axis=1, bitorder="little").reshape(-1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found, hashes, n = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").translate(_LOWER).split()
                grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)] if words else []
                before = len(hashes)
                hashes += [digest(g, seed) for g in grams]
                n.append(len(hashes) - before)
                if len(hashes) > 200_000:
                    found.append(bits(np.array(hashes, np.uint64), n))
                    hashes, n = [], []
            found.append(bits(np.array(hashes, np.uint64), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(K.tidied(run), "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: bits set in each segment. Manhattan distance between two is at most the Hamming distance."""
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, SEGMENTS, 64 // SEGMENTS).sum(2, dtype=np.uint8)


def grid_cells(points: DataFrame, radius: int, groups: int) -> DataFrame:
    """``(cell, fp, node)``: the grid cells of each point.

    Points within Manhattan distance ``radius`` agree in all coordinates of at least ``groups - radius`` of ``groups`` runs of
    segments, so a point falls to one cell, by its counts there, for each choice of that many runs.
    """
    runs = np.array_split(np.arange(SEGMENTS), groups)
    choices = list(combinations(range(groups), groups - radius))
    weight = np.random.default_rng(5).integers(0, 2**63, (SEGMENTS, 3), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (batch.column(c).to_numpy() for c in ("fp", "node"))
            count = popcounts(fp)
            of_run = [np.bitwise_xor.reduce(K.mix(weight[r, count[:, r]]), axis=1) if len(fp) else np.zeros(0, np.uint64) for r in runs]
            cells = [K.mix(np.bitwise_xor.reduce([of_run[r] for r in c], axis=0) + np.uint64(i)).view(np.int64) for i, c in enumerate(choices)]
            for cell in cells:
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("fp"), batch.column("node")], names=["cell", "fp", "node"])

    return points.select("fp", "node").mapInArrow(run, "cell long, fp long, node long")


def _links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        cell, part, cross, fp, node = (table.column(c).to_numpy() for c in ("cell", "part", "cross", "fp", "node"))
        count, forest = popcounts(np.ascontiguousarray(fp)).view(np.int8), Forest(len(fp))
        for i, j in pairs(cell, part, cross):
            near = np.abs(count[i] - count[j]).sum(1) <= radius
            i, j = i[near], j[near]
            same = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= radius
            forest.link(i[same], j[same])
        i, j = forest.edges()
        K.tidy()
        return pa.table({"a": node[i], "b": node[j]})

    return run


def links(prints: DataFrame, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of fingerprints ``(doc_id, fp)``: the distinct ones ``(fp, node)`` with their smallest doc_id, and links ``(a, b)`` between
    such nodes whose fingerprints differ in at most ``radius`` bits: enough of them to connect all that are."""
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "points")
    n = points.count()
    # Finer cells for more points: a choice of runs tells about 1.5 bits a segment apart.
    groups = next((g for g in range(radius + 2, radius + 5) if 48 * (g - radius) / g >= np.log2(max(n, 2)) - 2), radius + 5)
    cells = grid_cells(points, radius, groups)
    edges = cell_groups(cells, "node", n * comb(groups, radius), block=4096).groupBy("g").applyInArrow(_links(radius), "a long, b long")
    return points, stored(edges, "edges")


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """Link documents whose fingerprints differ in at most ``radius`` bits.

    Returns per row doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable by links.
    Equal fingerprints are one point, so copies make no pairs. A null or empty text, or one without words, has fingerprint
    zero and links like any other; a null doc_id keeps its row with the component of its fingerprint, but never names
    one unless it is alone. Rows that repeat a doc_id are kept each. An empty table gives an empty result; other columns are
    ignored.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    points, edges = links(prints, radius)
    names = components(edges)
    point_names = points.join(names, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(point_names, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The documents that are the first of their component: all columns of one row for each group of near copies.

    Rows with a null doc_id are kept. Rows that repeat the first doc_id are kept with it.
    """
    first = simhash_components(docs, radius, shingle).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
