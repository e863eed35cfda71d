"""A text index kept up by increments and read by buckets of terms.

Postings are signed: a changed or deleted document takes back what it had, so that sums over increments are the index of what is
there now, whatever their order. They are kept in blocks: a row for each term of a slice of documents. What a document had is told
from its own row, which holds its words in one line; terms are counted within slices of such lines, so there is no row for each word
or posting to group, shuffle or sort. An increment is a folder, and counts once its commit is written; one that is done again
replaces its own folder. A search reads the buckets of its terms alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelsift.operators.search import WORD

BLOCK = "term string, ids array<long>, tfs array<int>, lengths array<int>"
POSTINGS = f"{BLOCK}, inc string, bucket int"
DOCUMENTS = "id long, seq long, length long, line string, had_seq long, had_length long, inc string, bucket int"
STATS = "docs long, length long, inc string"
COMMITS = "replaces array<string>, inc string"

SLICES = 8  # tasks that share a bucket
SLICE_BYTES = 8 << 20  # lines whose terms are counted at once; a longer line is a slice of its own


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lines of a slice take at most SLICE_BYTES, one line at least."""
    for batch in batches:
        ends, start = np.cumsum(pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        words = pc.split_pattern(batch.column("line"), " ")
        coded = words.flatten().dictionary_encode()
        keys = coded.indices.to_numpy().astype(np.int64) * batch.num_rows + pc.list_parent_indices(words).to_numpy()
        keys, tf = np.unique(keys, return_counts=True)
        code, row = np.divmod(keys, batch.num_rows)
        sign = batch.column("sign").to_numpy()[row]
        # Every code occurs, so the blocks of 0, 1, ... follow each other.
        offsets = pa.array(np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code)).astype(np.int32))
        columns = batch.column("id").to_numpy()[row], (sign * tf).astype(np.int32), (sign * batch.column("length").to_numpy()[row]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]], ["term", "ids", "tfs", "lengths"])


def term_blocks(docs: DataFrame) -> DataFrame:
    """Postings of ``docs(id, length, line, sign)`` in blocks: a term with the ids, counts and lengths of a slice's documents."""
    return docs.where("length > 0").select("id", "length", "line", "sign").mapInArrow(_blocks, BLOCK)


class TextIndex:
    """An index at ``path`` of documents ``(id, text, seq)``; a null text deletes. ``buckets`` is fixed by the first increment."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])

    def increments(self) -> list[str]:
        """Those that count: committed, and not replaced by a later one that is their sum."""
        rows = self._read("commits", COMMITS).collect()
        gone = {x for r in rows for x in r.replaces or []}
        return sorted(r.inc for r in rows if r.inc not in gone)

    def _live(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).where(F.col("inc").isin(self.increments()))

    def _write(self, rows: DataFrame, name: str, inc: str, *by: str) -> None:
        out = rows.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/{name}/inc={inc}")

    def _commit(self, inc: str, replaces: list[str]) -> None:
        self._write(self.spark.range(0, 1, 1, 1).select(F.array(*map(F.lit, replaces)).cast("array<string>").alias("replaces")), "commits", inc)

    def _bucket(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows by their bucket, each bucket over several tasks; rows of one value stay together."""
        bucket = self._bucket(column)
        return rows.repartition(bucket, F.pmod(F.xxhash64(column, F.lit(SLICES)), F.lit(SLICES))).withColumn("bucket", bucket)

    def _write_documents(self, docs: DataFrame, inc: str) -> None:
        self._write(self._dealt(docs.select("id", "seq", "length", "line", "had_seq", "had_length"), "id"), "documents", inc, "bucket")

    def _write_postings(self, docs: DataFrame, inc: str) -> None:
        self._write(self._dealt(term_blocks(docs), "term").sortWithinPartitions("bucket", "term"), "postings", inc, "bucket")

    def _write_stats(self, stats: DataFrame, inc: str) -> None:
        self._write(stats.select(F.col("docs").cast("long").alias("docs"), F.col("length").cast("long").alias("length")), "stats", inc)

    def add(self, docs: DataFrame, inc: str) -> None:
        """Add or change documents; ``inc`` names the increment, and an increment of that name that is there already is done again.

        Of rows with one id, that of the greatest seq counts; one that is older than what the index has changes nothing."""
        if inc in self.increments():
            return
        # Texts are dealt out first, so that splitting them does not hang on how the source's files are cut, or on one id's many rows.
        rows = docs.select(F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), "text").where("id is not null and seq is not null").repartition("id", "seq")
        rows = rows.select("id", "seq", F.trim(F.regexp_replace(F.lower("text"), WORD, " ")).alias("line"))
        # Of rows with one id and seq, the one of the greatest words: a space sorts before every letter and digit.
        first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"), F.desc_nulls_last("line")))
        newest = self._kept(rows.withColumn("first", first).where("first = 1").drop("first"), f"{inc}-newest")
        # Only the buckets of these ids are read; there are at most ``buckets`` of them.
        touched = [r[0] for r in newest.select(self._bucket("id")).distinct().collect()]
        old = self._live("documents", DOCUMENTS).where(F.col("bucket").isin(touched))
        heads = old.groupBy("id").agg(F.max("seq").alias("had_seq"), F.max_by("length", "seq").alias("had_length"))
        length = F.when(F.col("line") == "", 0).when(F.col("line").isNotNull(), F.size(F.split("line", " "))).cast("long")
        newest = newest.join(heads, "id", "left").where("had_seq is null or had_seq < seq")
        self._write_documents(newest.withColumn("length", length), inc)
        new = self.spark.read.schema(DOCUMENTS).parquet(f"{self.path}/documents/inc={inc}")
        gone = old.join(new.where("had_seq is not null").select("id", F.col("had_seq").alias("seq")), ["id", "seq"], "left_semi")
        side = lambda rows, sign: rows.select("id", "length", "line", F.lit(sign).alias("sign"))
        self._write_postings(side(new, 1).union(side(gone, -1)), inc)
        stats = new.agg(F.coalesce(F.sum(F.col("length").isNotNull().cast("long") - F.col("had_length").isNotNull().cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.coalesce("length", F.lit(0)) - F.coalesce("had_length", F.lit(0))), F.lit(0)).alias("length"))
        self._write_stats(stats, inc)
        self._commit(inc, [])

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def compact(self) -> None:
        """Sum all increments up in one; those before are left out from its commit on."""
        old = self.increments()
        if len(old) < 2:
            return
        docs = self._live("documents", DOCUMENTS)
        docs = docs.join(docs.groupBy("id").agg(F.max("seq").alias("seq")), ["id", "seq"]).withColumns({"had_seq": F.lit(None).cast("long"), "had_length": F.lit(None).cast("long")})
        stats = self._live("stats", STATS).agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))
        inc = f"sum-{uuid.uuid4().hex}"
        self._write_documents(docs, inc)
        self._write_postings(docs.withColumn("sign", F.lit(1)), inc)
        self._write_stats(stats, inc)
        self._commit(inc, old)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Z-01: keep the index up with a stream of ``(id, text, seq)``; a restart goes on after the last increment, and a batch
        that is sent again is known by its number."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.add(batch, f"batch-{number:012d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def postings(self, terms: list[str]) -> DataFrame:
        """term, id, tf and length of the documents that are there now, from the buckets of the terms alone."""
        return self._postings(terms, self.increments())

    def _postings(self, terms: list[str], live: list[str]) -> DataFrame:
        wanted = sorted(set(terms))
        buckets = {self.spark.sql("select pmod(xxhash64(:t), :n)", args={"t": t, "n": self.buckets}).first()[0] for t in wanted}
        rows = self._read("postings", POSTINGS).where(F.col("inc").isin(live) & F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(wanted))
        rows = rows.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths")).alias("id", "tf", "length"))
        return rows.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.sum("length").alias("length")).where("tf > 0")

    def _corpus(self, live: list[str]) -> DataFrame:
        total = self._read("stats", STATS).where(F.col("inc").isin(live)).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("all"))
        return total.select("docs", F.when(F.col("docs") > 0, F.col("all") / F.col("docs")).otherwise(1.0).alias("mean"))

    def corpus(self) -> tuple[int, float]:
        """Documents, and their mean length (1 without any)."""
        return tuple(self._corpus(self.increments()).first())

    def search(self, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """T-02: id and score of the documents that hold all terms: their BM25 as score / (1 + score)."""
        wanted, live = sorted(set(terms)), self.increments()
        hits = self._postings(wanted, live)
        # A row for each document; and figures of the corpus, one row.
        each = hits.groupBy("id").agg(F.max("length").alias("length"), *[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(wanted)])
        df = hits.agg(*[F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(wanted)])
        figures = df.crossJoin(F.broadcast(self._corpus(live)))
        idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        all_ = reduce(lambda x, y: x & y, [F.col(f"tf{i}").isNotNull() for i in range(len(wanted))], F.lit(True))
        score = reduce(lambda x, y: x + y, map(part, range(len(wanted))), F.lit(0.0))
        found = each.where(all_).crossJoin(F.broadcast(figures)).select("id", score.alias("bm25"))
        return found.select("id", F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))
