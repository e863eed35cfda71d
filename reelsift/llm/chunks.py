"""Distinct-word tables in two exchanges.

Texts are dealt out in chunks. Each chunk sends its distinct words, once each, to buckets by word hash; a bucket sees every
word of the corpus that falls to it once, works out what is asked for, and answers each chunk in the order of its request.
The chunk then joins the answers back by word and position. Only compressed blobs travel, a row per chunk and bucket, so
that a frequent word weighs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.common import text_bytes

Splitter = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def to_blob(**arrays: pa.Array | np.ndarray) -> bytes:
    """Equally long arrays as one compressed blob."""
    batch = pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes | pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob) if isinstance(blob, bytes) else blob.as_buffer()).read_all()


def chunked(docs: DataFrame, chunk_bytes: int, ordered: bool = False) -> tuple[DataFrame, int]:
    """docs packed as rows ``(chunk, blob)``, and the number of chunks.

    A hash of doc_id deals them out, or, ``ordered``, ranges of doc_id (null first) that hold about as many rows each.
    """
    n = max(1, -(-text_bytes(docs) // chunk_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if ordered and n > 1 else []
    deal = F.coalesce("doc_id", F.lit(-(2**63))) if ordered else F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n))
    bounds = np.unique(np.array(bounds, np.int64)) if ordered else None
    return rows.withColumn("chunk", deal).mapInArrow(K.tidied(lambda it: _pack(it, bounds)), "chunk int, blob binary"), n


def _pack(batches: Iterator[pa.RecordBatch], bounds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
        if bounds is not None:
            chunk = np.searchsorted(bounds, chunk, "left")
        order = np.argsort(chunk, kind="stable")
        cut = np.flatnonzero(np.diff(chunk[order])) + 1
        for rows in np.split(order, cut):
            part = batch.select(["doc_id", "text"]).take(pa.array(rows))
            blob = to_blob(doc_id=part.column(0), text=part.column(1).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array([chunk[rows[0]]], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "blob"])


def docs_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids in order, and the texts of a chunk as a buffer with offsets."""
    rows = pa.concat_tables([from_blob(b) for b in table.column("blob").combine_chunks()]) if table.num_rows else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.large_string())})
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    data, offsets = K.flat(rows.column("text"))
    return rows.column("doc_id").combine_chunks(), data, offsets


class Vocabulary:
    """The distinct words of a chunk, told apart by their bytes, in the order of its requests: by bucket, then hash, then bytes.

    word: the number of each word of the texts, in order; to: where each text's words begin; words: the distinct words. Words
    are found slice by slice, so that only numbers of 4 bytes stand for all of them at once.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, split: Splitter, buckets: int):
        found, inverse, count, known = [], [], [np.zeros(1, np.int64)], 0
        for i, j in K.slices(offsets):
            lo = offsets[i]
            part = data[lo : offsets[j]]
            s, e, text = split(part, offsets[i : j + 1] - lo)
            count.append(np.bincount(text, minlength=j - i))
            if not len(s):
                continue
            coded = K.strings(part, s, e).dictionary_encode()
            found.append(coded.dictionary), inverse.append(coded.indices.to_numpy() + np.int32(known))
            known += len(coded.dictionary)
        coded = pa.concat_arrays(found or [pa.array([], pa.large_binary())]).dictionary_encode()
        flat, to = K.flat(coded.dictionary)
        hashes = K.string_hashes(flat, to)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        # Unequal words of one hash: the order of requests must not depend on that of the texts.
        for h in np.unique(hashes[order[1:]][hashes[order[1:]] == hashes[order[:-1]]]):
            at = np.flatnonzero(hashes[order] == h)
            order[at] = sorted(order[at], key=lambda i: flat[to[i] : to[i + 1]].tobytes())
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.bucket, self.to = coded.dictionary.take(pa.array(order)), bucket[order], np.cumsum(np.concatenate(count))
        self.word = rank[coded.indices.to_numpy()][np.concatenate(inverse)] if inverse else np.zeros(0, np.int32)

    def requests(self, chunk: int, **also: np.ndarray) -> pa.Table:
        """One row per bucket with the words that it is asked for, and arrays along the distinct words."""
        cut = np.append(np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.bucket))
        blobs = [to_blob(word=self.words[a:b], **{k: v[a:b] for k, v in also.items()}) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"bucket": pa.array(self.bucket[cut[:-1]], pa.int32()), "chunk": pa.array([chunk] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def answers_of(table: pa.Table) -> pa.Table:
    """The answers to a chunk, in the order of its distinct words."""
    table = table.sort_by("bucket")
    return pa.concat_tables([from_blob(b) for b in table.column("blob").combine_chunks()]).combine_chunks() if table.num_rows else pa.table({})


def distinct_of(blobs: list[pa.Table]) -> tuple[pa.Array, list[np.ndarray]]:
    """All distinct words asked for in a bucket, and for each request the places of its words among them."""
    words = pa.chunked_array([b.column("word").combine_chunks() for b in blobs], pa.large_binary())
    coded = words.combine_chunks().dictionary_encode()
    places = coded.indices.to_numpy()
    cut = np.cumsum([b.num_rows for b in blobs])[:-1]
    return coded.dictionary, np.split(places, cut)


REQUEST = "bucket int, chunk int, blob binary"


def exchange(packed: DataFrame, ask: Callable[[pa.Table], pa.Table], answer: Callable[[pa.Table], pa.Table], join: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """ask over each chunk, answer over each bucket, join of each chunk with its answers."""
    def asked(table: pa.Table) -> pa.Table:
        out = ask(table)
        K.tidy()
        return out

    def answered(table: pa.Table) -> pa.Table:
        out = answer(table)
        K.tidy()
        return out

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = join(left, right)
        K.tidy()
        return out

    replies = packed.groupBy("chunk").applyInArrow(asked, REQUEST).groupBy("bucket").applyInArrow(answered, REQUEST)
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(joined, schema)
