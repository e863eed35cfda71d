"""Near copies by shared word shingles: candidates by SimHash (operator 5) and by minimum hashes, links by their exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm import simhash
from reelsift.llm.common import bound_batches, components, stored
from reelsift.llm.near import Forest, cell_groups

#: A pair at similarity s shares a cell with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8.
BANDS, ROWS = 12, 3
#: What a row weighs besides its shingles.
ROW = 256
#: Candidate documents whose ids may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_RANDOM = np.random.default_rng(11)
_FLIP, _TIMES = (_RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SETS = _RANDOM.integers(0, 2**63, 2, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each text, one text after the other, and where each text's begin.

    Words are in lower case (A-Z). A text of fewer than ``size`` words is one shingle; one without words has none.
    """
    start, end, text = K.words(data, offsets)
    word = K.mix(K.Hashes(K.LOWER[data]).of(start, end))
    n, value = len(word), np.zeros(len(word), np.uint64)
    for j in range(size):
        value *= np.uint64(0x9E3779B97F4A7C15)
        inside = text[j:] == text[: n - j]
        value[: max(0, n - j)] += np.where(inside, word[j:], 0).astype(np.uint64)
    whole = np.zeros(n, bool)
    whole[: max(0, n - size + 1)] = text[size - 1 :] == text[: max(0, n - size + 1)]
    first = np.append(True, text[1:] != text[:-1])[:n]
    short = np.bincount(text, minlength=len(offsets) - 1)[text] < size
    at = np.flatnonzero(whole | (first & short))
    value, text = K.mix(value[at]), text[at]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(offsets)))


def set_keys(value: np.ndarray, to: np.ndarray) -> list[pa.Array]:
    """128 bits of hash of each set, in two columns."""
    out = []
    for flip in _SETS:
        sums = np.append(np.uint64(0), np.cumsum(K.mix(value ^ flip), dtype=np.uint64))
        out.append(pa.array(K.mix(sums[to[1:]] - sums[to[:-1]]).view(np.int64)))
    return out


def _cells(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            for i, j in K.slices(offsets):
                value, to = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                some = np.flatnonzero(np.diff(to))
                least = np.stack([np.minimum.reduceat((value ^ f) * t, to[some]) for f, t in zip(_FLIP, _TIMES)], axis=1) if len(some) else np.zeros((0, BANDS * ROWS), np.uint64)
                cell = np.zeros((len(some), BANDS), np.uint64)
                for r in range(ROWS):
                    cell = K.mix(cell + least[:, r::ROWS]) + np.arange(BANDS, dtype=np.uint64)
                count = np.zeros(j - i + 1, np.int32)
                count[some + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(cell.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *set_keys(value, to), pa.array(np.diff(to)), lists], names=["doc_id", "hash", "more", "size", "cells"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column("text"))
            for i, j in K.slices(offsets):
                value, to = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                shingles = pa.array([value[a:b].tobytes() for a, b in zip(to, to[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *set_keys(value, to), shingles], names=["doc_id", "hash", "more", "shingles"])

    return run


def _links(similarity: float):
    """Links between the sets of each cell, of which a pair that is linked already needs no look."""

    def run(table: pa.Table) -> pa.Table:
        cell, parts, across = (table.column(c).to_numpy() for c in ("cell", "part", "cross"))
        key, first, at = np.unique(table.column("key").to_numpy(), return_index=True, return_inverse=True)
        column = table.column("shingles")
        sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in first]
        length, forest = np.array([len(s) for s in sets]), Forest(len(sets))
        order = np.argsort(cell, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            members, where = np.unique(at[own], return_index=True)
            part, cross = parts[own[where]], across[own].any()
            for k, pivot in enumerate(members[:-1]):
                label = forest.label[members]
                if (label == label[0]).all():
                    break
                rest = members[k + 1 :][(label[k + 1 :] != label[k]) & (part[k + 1 :] != part[k] if cross else True)]
                rest = rest[np.minimum(length[rest], length[pivot]) >= similarity * np.maximum(length[rest], length[pivot])]
                for some in np.array_split(rest, length[rest].sum() // 1_000_000 + 1) if len(rest) else ():
                    if not len(some):
                        continue
                    all_of = np.concatenate([sets[i] for i in some])
                    found = sets[pivot][np.minimum(np.searchsorted(sets[pivot], all_of), length[pivot] - 1)] == all_of
                    both = np.add.reduceat(found, np.append(0, np.cumsum(length[some])[:-1]), dtype=np.int64)
                    near = some[both >= similarity * (length[some] + length[pivot] - both)]
                    forest.link(np.full(len(near), pivot), near)
        i, j = forest.edges()
        K.tidy()
        return pa.table({"a": key[i], "b": key[j]})

    return run


def _alike(similarity: float):
    """Whether the sets ``shingles`` and ``of_pivot`` of a row are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("shingles"), batch.column("of_pivot"))):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
                near[k] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("key", "pivot")], names=["a", "b"])

    return run


def dedup(docs: DataFrame, similarity: float = 0.8, size: int = 5, block: int = 500_000) -> DataFrame:
    """The documents that are the first of their group of near copies: all columns of one row for each.

    Documents are linked where the Jaccard similarity of their sets of ``size``-word shingles is ``similarity`` or more, by exact
    sets of 64-bit hashes; groups are the connected ones. Candidates are the links of SimHash, by popcounts of segments, their grid and
    Manhattan bound, and, as three bits of 64 reach few pairs of 0.8, those that share a cell of minimum hashes. Texts without words are copies of each other. Rows with a null doc_id
    are kept. Rows that repeat the first doc_id are kept with it. An empty table gives an empty result.

    No task holds more than twice ``block`` shingles (a row counts as 256 more), or a set, if one is larger. In cells beyond ``block`` all sets are compared
    with one of them first; those that it links need no comparing with each other.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = rows.mapInArrow(K.tidied(_cells(size)), "doc_id long, hash long, more long, size long, cells array<long>")
    points = prints.groupBy("hash", "more").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("cells").alias("cells"))
    points = stored(points.withColumn("key", F.monotonically_increasing_id()), "points")  # numbers for the 128 bits, as written
    cells = points.select(F.explode("cells").alias("cell"), "key", "size")
    shared = stored(cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("key").alias("pivot")).where("n > 1"), "cells")
    # SimHash, of one document for each set: sets that share a fingerprint meet its first one, and fingerprints near each other meet.
    prints = stored(simhash.fingerprints(rows).join(points.where("size > 0").select(F.col("node").alias("doc_id"), "key"), "doc_id").select(F.col("key").alias("doc_id"), "fp"), "fingerprints")
    first_of, near = simhash.links(prints)
    same = prints.join(first_of, "fp").select(F.col("doc_id").alias("key"), F.col("node").alias("pivot"))
    met = stored(same.union(near).where("key <> pivot").distinct(), "met")
    in_cells = cells.join(shared, "cell").select("key").union(met.select("key")).union(met.select("pivot"))
    wanted = stored(points.join(in_cells.distinct(), "key", "left_semi").select(F.col("node").alias("doc_id"), "hash", "more", "key"), "candidates")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = rows.join(ids, "doc_id", "left_semi").mapInArrow(K.tidied(_sets(size)), "doc_id long, hash long, more long, shingles binary")
    sets = stored(sets.join(ids, ["doc_id", "hash", "more"]).select("key", "shingles").dropDuplicates(["key"]), "sets")
    # Large cells: what a pivot links is settled.
    large = cells.join(shared.where(F.col("weight") + ROW * F.col("n") > block).select("cell", "pivot"), "cell")
    trials = large.where("key <> pivot").select("key", "pivot").union(met).distinct().join(sets, "key").join(sets.select(F.col("key").alias("pivot"), F.col("shingles").alias("of_pivot")), "pivot")
    linked = stored(trials.mapInArrow(K.tidied(_alike(similarity)), "a long, b long"), "linked")
    settled = large.join(linked, (F.col("key") == F.col("a")) & (F.col("pivot") == F.col("b"))).select("cell", "key", F.lit(True).alias("settled"))
    flagged = cells.join(settled, ["cell", "key"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    total = shared.agg(F.sum(F.col("weight") + ROW * F.col("n"))).first()[0] or 0
    groups = cell_groups(flagged, "key", total, block, 2 * block, F.col("size") + ROW, F.col("settled")).select("g", "cell", "part", "cross", "key").join(sets, "key")
    edges = groups.groupBy("g").applyInArrow(_links(similarity), "a long, b long")
    names = components(stored(edges.union(linked), "edges"))
    named = points.join(names.withColumnRenamed("node", "key"), "key", "left").select("node", F.coalesce("component", "key").alias("component"))
    first = named.groupBy("component").agg(F.min("node").alias("doc_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
