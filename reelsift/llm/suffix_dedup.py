"""Exact substring dedup with a logarithmic family of sparse suffix arrays (operator 1).

A suffix array here is a bucketed table of sampled suffixes, sorted by ``(key, ctx)``. A suffix is sampled where its first
``anchor`` bytes have the least hash among the positions of some ``min_len``-byte string: a choice that depends on that
string alone, so two equal strings hold a sampled suffix at the same place and no repeat is lost. Each sampled suffix
stands for the run of strings that chose it: ``key`` hashes its first bytes, ``ctx`` the whole stretch of that run.

Each new batch gets a suffix array. It is merge-scanned against every level that exists, by sort-merge joins of their buckets
without a shuffle: stretches that an older level has are repeats, and leave the array as spans. Levels of equal size are merged
the same way to one of twice the size. In the last level, keys with more than one stretch are settled exactly, string by
string, from the bytes of the texts. Order is that of hashes, not of the bytes: arrays with 100 bytes of each suffix in them
would not fit the disk limits, and equal prefixes of fixed lengths are neighbours in either order.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.llm import kernels as K
from reelsift.llm.chunks import from_blob, to_blob
from reelsift.llm.common import bound_batches, release, shared_dir, stored, text_bytes

SUFFIX = "key long, ctx long, doc_id long, at long, shape long, first boolean"
SPAN = "doc_id long, s long, e long"
_POSITION = 23  # bits for a position within a piece; the hash keeps the others


def _pieces(data: np.ndarray, offsets: np.ndarray, min_len: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    n = len(data) - min_len + 1
    for lo in range(0, max(n, 0), size):
        yield lo, min(lo + size, n)


def sample(data: np.ndarray, offsets: np.ndarray, min_len: int, anchor: int) -> tuple[np.ndarray, ...]:
    """key, ctx, text number, first start, last start, sampled position of each run of strings in the texts of a buffer."""
    width, found = min_len - anchor + 1, []
    low = np.uint64((1 << _POSITION) - 1)
    for lo, hi in _pieces(data, offsets, min_len):
        part = data[lo : hi + min_len - 1]
        two, key = K.Hashes(part, 1), K.anchors(part, anchor)
        value = (key & ~low) | np.arange(len(key), dtype=np.uint64)
        pad = -len(value) % width
        blocks = np.append(value, np.full(pad, ~np.uint64(0))).reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = hi - lo
        least = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & low).astype(np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, lo, hi)))
        ok = np.flatnonzero(np.arange(lo, hi) + min_len <= offsets[text + 1])
        if not len(ok):
            continue
        pick, owner = least[ok], text[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(ok)) - 1
        s0, s1, a = ok[i], ok[j], pick[i]
        ctx = K.mix(two.of(s0, s1 + min_len) + ((a - s0) * width + (s1 - s0)).astype(np.uint64))
        found.append((key[a], ctx, owner[i], s0 + lo, s1 + lo, a + lo))
    if not found:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))


def sampled_suffixes(docs: DataFrame, min_len: int = 100, anchor: int = 32) -> DataFrame:
    """Sampled suffixes of all texts. Of equal stretches in one Arrow batch only the first is ``first``: those with the
    others would meet again in one bucket, so they are dealt out by document instead."""
    width = min_len - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = K.flat(batch.column("text"))
            key, ctx, text, s0, s1, a = sample(data, offsets, min_len, anchor)
            doc, at = ids[text], s0 - offsets[text]
            order = np.lexsort((at, doc, ctx, key))
            first = np.ones(len(order), bool)
            first[1:] = (key[order][1:] != key[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])
            key, ctx, doc, at, shape = key[order], ctx[order], doc[order], at[order], ((a - s0) * width + s1 - s0)[order]
            key = np.where(first, key, K.mix(doc.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(at), pa.array(shape), pa.array(first)], names=["key", "ctx", "doc_id", "at", "shape", "first"])

    return docs.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= %d" % min_len).mapInArrow(K.tidied(run), SUFFIX)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, ctx, doc_id, at: a stretch like the one before it repeats an earlier one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ctx, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "ctx", "first"))
        where = np.flatnonzero(first)
        k, c = key[where], ctx[where]
        same = np.zeros(len(where), bool)
        same[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
        if len(where):
            same[0] = last == (k[0], c[0])
            last = (k[-1], c[-1])
        out = first.copy()
        out[where[same]] = False
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out)], names=batch.schema.names)


class SuffixIndex:
    """The family of levels. ``add`` takes batches in ascending doc_id order; ``repeats`` gives the spans found."""

    def __init__(self, spark: SparkSession, min_len: int = 100, anchor: int = 32, buckets: int | None = None):
        if not 8 <= anchor <= min_len:
            raise ValueError("anchor must lie between 8 and min_len")
        shared_dir(spark)
        self.spark, self.min_len, self.anchor = spark, min_len, anchor
        self.buckets = buckets
        self.levels: list[tuple[int, str]] = []
        self.tables: list[str] = []
        self.spans: list[DataFrame] = []

    def _write(self, df: DataFrame) -> str:
        name, conf, all_keys = f"suffixes_{uuid.uuid4().hex}", self.spark.conf, "spark.sql.requireAllClusterKeysForCoPartition"
        before = conf.get(all_keys)
        conf.set(all_keys, "false")  # buckets by key serve a join by key and ctx too
        try:
            df.write.option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key", "ctx").saveAsTable(name)
        finally:
            conf.set(all_keys, before)
        self.tables.append(name)
        return name

    def add(self, batch: DataFrame) -> None:
        if self.buckets is None:
            self.buckets = max(8, min(4096, text_bytes(batch) // (8 << 20)))
        # Repeats within an Arrow batch are known at once; the others are found in sorted order of their bucket.
        rows = sampled_suffixes(batch, self.min_len, self.anchor)
        array = rows.repartition(self.buckets, "key").sortWithinPartitions("key", "ctx", "doc_id", "at").mapInArrow(_scan, SUFFIX)
        name, size, kept = self._write(array), 1, len(self.levels)
        while kept and self.levels[kept - 1][0] == size:  # the levels that merge with it now are scanned as they do
            kept, size = kept - 1, 2 * size
        if kept:
            name = self._against(name, [old for _, old in self.levels[:kept]])
        self.levels.append((1, name))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            self._merge()

    def _leave(self, *names: str) -> None:
        """Keep the repeats of tables that are read for the last time, as spans."""
        width = self.min_len - self.anchor + 1
        rows = _union([self.spark.table(t).where("not first") for t in names])
        self.spans.append(stored(rows.select("doc_id", F.col("at").alias("s"), (F.col("at") + F.col("shape") % width + self.min_len).alias("e")), "repeats"))

    def _against(self, name: str, levels: list[str]) -> str:
        """The array of a new batch, less what any of the levels has."""
        self._leave(name)
        rows, seen = self.spark.table(name).where("first"), F.lit(False)
        for k, old in enumerate(levels):
            rows = rows.join(self.spark.table(old).where("first").select("key", "ctx", F.lit(True).alias(f"seen{k}")), ["key", "ctx"], "left")
            seen = seen | F.col(f"seen{k}").isNotNull()
        out = self._write(rows.select("key", "ctx", "doc_id", "at", "shape", (~seen).alias("first")))
        self._drop(name)
        return out

    def _merge(self) -> None:
        (size, b), (more, a) = self.levels.pop(), self.levels.pop()
        self._leave(a, b)
        old, new = self.spark.table(a), self.spark.table(b)
        old, new = (t.where("first").select("key", "ctx", F.struct("doc_id", "at", "shape").alias("w")) for t in (old, new))
        pair = old.alias("o").join(new.alias("n"), ["key", "ctx"], "full_outer")
        entry = lambda w, first: F.struct("key", "ctx", F.col(f"{w}.doc_id").alias("doc_id"), F.col(f"{w}.at").alias("at"), F.col(f"{w}.shape").alias("shape"), first.alias("first"))
        rows = pair.select(F.explode(F.filter(F.array(entry("o.w", F.lit(True)), entry("n.w", F.col("o.w").isNull())), lambda x: x.doc_id.isNotNull())).alias("x")).select("x.*")
        self.levels.append((size + more, self._write(rows)))
        self._drop(a, b)
        release(self.spark)

    def close(self) -> None:
        """Merge what is left into one level."""
        while len(self.levels) > 1:
            self._merge()

    def _drop(self, *names: str) -> None:
        for t in names:
            self.spark.sql(f"drop table if exists {t}")
            self.tables.remove(t)

    def drop(self) -> None:
        self._drop(*list(self.tables))

    def repeats(self, docs: DataFrame, hot: int = 1_000) -> DataFrame:
        """All spans of strings that start earlier too. The strings of keys of over ``hot`` stretches are dealt out by their
        own hash, equal ones combined before the shuffle, rather than settled in one task."""
        self.close()
        min_len, width = self.min_len, self.min_len - self.anchor + 1
        if not self.levels:
            return self.spark.createDataFrame([], SPAN)
        last = self.spark.table(self.levels[0][1])
        self._leave(self.levels[0][1])
        spans = list(self.spans)
        shared = last.where("first").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        open_ = last.where("first").join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("key", "n", "at", "shape")).alias("open"))
        stretches = stored(docs.select("doc_id", "text").join(open_, "doc_id").mapInArrow(K.tidied(_cut(min_len, width)), "key long, n long, doc_id long, s long, runs long, bytes binary"), "stretches")
        release(self.spark)
        count = stretches.count()
        groups = max(1, count // 5_000)
        few = stretches.where(F.col("n") <= hot).withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("g").applyInArrow(lambda t: _settle(t, min_len), SPAN)
        # Strings of large groups, packed by hash: about 40 to a stretch, and as many to a group as one task settles.
        large = stretches.where(F.col("n") > hot)
        bins = max(1, large.count() * 40 // 400_000)
        many = large.mapInArrow(K.tidied(_strings(min_len, bins)), "g int, blob binary").groupBy("g").applyInArrow(_settle_strings(min_len), SPAN)
        spans += [few, many]
        return _union(spans)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _cut(min_len: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = K.flat(batch.column("text"))
            lists = batch.column("open")
            rows, text = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            key, n, at, shape = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "at", "shape"))
            start = offsets[text] + at
            end = np.minimum(start + shape % width + min_len, offsets[text + 1])
            for i in range(0, len(key), 50_000):
                cut = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(n[cut]), pa.array(ids[text[cut]]), pa.array(at[cut]), pa.array((shape % width + 1)[cut]), K.strings(data, start[cut], end[cut]).cast(pa.binary())], names=["key", "n", "doc_id", "s", "runs", "bytes"])

    return run


def _windows(table: pa.Table | pa.RecordBatch, min_len: int) -> tuple[np.ndarray, ...]:
    """Two hashes, doc_id and start of every string of min_len bytes in the stretches."""
    data, offsets = K.flat(table.column("bytes"))
    runs = np.minimum(table.column("runs").to_numpy(), np.maximum(0, np.diff(offsets) - min_len + 1))
    row = np.repeat(np.arange(len(runs)), runs)
    j = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = offsets[row] + j
    return K.Hashes(data).of(at, at + min_len), K.Hashes(data, 1).of(at, at + min_len), table.column("doc_id").to_numpy()[row], table.column("s").to_numpy()[row] + j


def _order(h: np.ndarray, more: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings by their 128 bits of hashes, then place; and which are the first of equal ones."""
    order = np.lexsort((s, doc, more, h))
    first, h, more = np.ones(len(order), bool), h[order], more[order]
    first[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    return order, first


def _spans(doc: np.ndarray, s: np.ndarray, min_len: int) -> list[pa.Array]:
    """Runs of neighbouring starts as spans."""
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + 1)
    i = np.flatnonzero(new)
    return [pa.array(doc[i]), pa.array(s[i]), pa.array(s[np.append(i[1:], len(doc)) - 1] + min_len if len(i) else s)]


def _settle(table: pa.Table, min_len: int) -> pa.Table:
    h, more, doc, s = _windows(table, min_len)
    order, first = _order(h, more, doc, s)
    again = order[~first]
    K.tidy()
    return pa.Table.from_arrays(_spans(doc[again], s[again], min_len), names=["doc_id", "s", "e"])


def _strings(min_len: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                h, more, doc, s = _windows(batch.slice(i, 5_000), min_len)
                order, first = _order(h, more, doc, s)
                once, again = order[first], order[~first]
                # Of equal strings here only the first goes on; the others are repeats already, given as runs.
                runs = [x.to_numpy() for x in _spans(doc[again], s[again], min_len)]
                parts = [np.concatenate(x) for x in zip((h[once], more[once], doc[once], s[once], s[once] + min_len, np.ones(len(once), bool)), (K.mix(runs[0].astype(np.uint64)), np.zeros(len(runs[0]), np.uint64), *runs, np.zeros(len(runs[0]), bool)))]
                at = (parts[0] % np.uint64(bins)).astype(np.int32)
                by = np.argsort(at, kind="stable")
                for rows in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                    if len(rows):
                        blob = to_blob(**{k: x[rows] for k, x in zip(("hash", "more", "doc_id", "s", "e", "first"), parts)})
                        yield pa.RecordBatch.from_arrays([pa.array(at[rows[:1]]), pa.array([blob], pa.binary())], names=["g", "blob"])

    return run


def _settle_strings(min_len: int):
    def run(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([from_blob(b) for b in table.column("blob").combine_chunks()]).combine_chunks()
        h, more, doc, s, e, first = (rows.column(c).to_numpy() for c in ("hash", "more", "doc_id", "s", "e", "first"))
        order, new = _order(h[first], more[first], doc[first], s[first])
        again = order[~new]
        found = _spans(doc[first][again], s[first][again], min_len)
        K.tidy()
        return pa.Table.from_arrays([pa.array(np.concatenate([x.to_numpy(), y[~first]])) for x, y in zip(found, (doc, s, e))], names=["doc_id", "s", "e"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column("text"))
        spans, rows = batch.column("spans"), []
        for i in range(batch.num_rows):
            text, cut = data[offsets[i] : offsets[i + 1]], spans[i]
            s = e = np.zeros(0, np.int64)
            if cut.is_valid and len(text):
                s, e = K.merged(*(cut.values.field(x).to_numpy(zero_copy_only=False) for x in "se"))
                e = np.minimum(e, len(text))
            keep = np.ones(len(text), bool)
            for x, y in zip(s, e):
                keep[x:y] = False
            kept = text[keep].tobytes() if len(s) else text.tobytes()
            rows.append((len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, min_len: int = 100, anchor: int = 32, n_batches: int = 8, hot: int = 1_000) -> DataFrame:
    """Remove every byte covered by a ``min_len``-byte string that also starts earlier.

    Earlier: in a text of smaller doc_id, or at a smaller start of the same text. Texts are UTF-8 bytes and matches do not
    cross them. Returns per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes ``kept``.

    Null or empty texts, and texts shorter than ``min_len``: nothing is removed. Null doc_id: the row is returned, its text
    is neither cut nor compared. Rows that repeat a doc_id are one text in the order, so that each keeps what only such a
    twin has at the same start. An empty table gives an empty result; other columns are ignored.

    The documents come to the index in ``n_batches`` ranges of doc_id, as they would if they arrived over time.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    index = SuffixIndex(spark, min_len, anchor, max(8, min(65536, text_bytes(docs) // (8 << 20))))
    cuts = docs.stat.approxQuantile("doc_id", [i / n_batches for i in range(1, n_batches)], 0.01) if n_batches > 1 else []
    cuts = sorted(set(cuts))
    try:
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            part = docs
            part = part if lo is None else part.where(F.col("doc_id") > int(lo))
            index.add(part if hi is None else part.where(F.col("doc_id") <= int(hi)))
        spans = index.repeats(docs, hot)
        # A document's spans number no more than its sampled suffixes.
        spans = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    finally:
        index.drop()
    release(spark)
    return docs.join(spans, "doc_id", "left").mapInArrow(K.tidied(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
